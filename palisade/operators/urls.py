"""URLs and runtime network calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.urls import is_under, url_host
from palisade.operators.matching import match_content, occurrences
from palisade.rules import network
from palisade.rules.base import Rule, text_files
from palisade.rules.network import SAFE_HOSTS
from palisade.schema import as_findings

# Fixed values.
URL_PATTERN = r"https?://[^\s\"'<>(){}|;`\[\]\\,]+"
TRAILING_PUNCTUATION = ".,:;!?)]}"
SUSPICIOUS_TLDS = (
    "tk", "ml", "ga", "cf", "gq", "pw", "top", "icu",
    "xyz", "work", "loan", "date", "men", "click",
    "download", "review", "stream", "trade", "win",
    "bid", "racing",
)
# "beacon" stands twice and therefore signals twice.
SUSPICIOUS_KEYWORDS = (
    "payload", "shell", "backdoor", "exploit", "malware",
    "c2", "cnc", "command", "control", "beacon",
    "reverse", "connect", "tunnel", "proxy", "stager",
    "dropper", "update", "upgrade", "patch",
    "callback", "webhook", "tracker", "beacon",
    "exfil", "exfiltrate", "collect", "telemetry",
)
C2_DOMAINS = (
    "pastebin.com", "raw.githubusercontent.com", "ngrok.io",
    "serveo.net", "localtunnel.me", "requestbin",
    "hookbin.com", "webhook.site", "pipedream.com",
    "cloudfront.net", "s3.amazonaws.com",
)
# IPv4 ranges that count as private, first and last address.
PRIVATE_RANGES = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"),
    ("240.0.0.0", "255.255.255.255"),
)
LONG_URL = 500
GATE = text_files


def url_userinfo(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[A-Za-z]+://([^/?#]*)@", 1)


def ipv4_number(host: Column) -> Column:
    """Dotted quad as a number, null for anything else (leading zeros are not an address)."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    shape = rf"^{octet}\.{octet}\.{octet}\.{octet}\z"
    part = [F.regexp_extract(host, shape, i).cast("long") for i in (1, 2, 3, 4)]
    return F.when(host.rlike(shape), ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3])


def _number(address: str) -> int:
    a, b, c, d = (int(x) for x in address.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def extract_urls(files: DataFrame) -> DataFrame:
    """Every URL occurrence: repo_id, path, url, line_no."""
    rule = Rule("N1", "url_network", URL_PATTERN, "high", "c2_callback", "", ignore_case=True, needles=("://",), gate=GATE)
    return occurrences(files, [rule]).select(
        "repo_id", "path", F.rtrim("matched", F.lit(TRAILING_PUNCTUATION)).alias("url"), "line_no"
    )


def distinct_urls(urls: DataFrame) -> DataFrame:
    """First line per URL and file; the minimum is combined before the shuffle."""
    return urls.groupBy("repo_id", "path", "url").agg(F.min("line_no").alias("line_no"))


def with_url_parts(urls: DataFrame) -> DataFrame:
    host = url_host(F.col("url"))
    return urls.withColumns({"host": host, "userinfo": url_userinfo(F.col("url"))}).withColumn(
        "tld", F.when(F.contains(F.col("host"), F.lit(".")), F.substring_index("host", ".", -1)).otherwise("")
    )


def with_signals(urls: DataFrame) -> DataFrame:
    """Suspicion signals of each URL as an array of texts, in a fixed order."""
    host, url = F.col("host"), F.col("url")
    number = ipv4_number(host)
    private = F.lit(False)
    for low, high in PRIVATE_RANGES:
        private = private | number.between(_number(low), _number(high))
    loopback = number.between(_number("127.0.0.0"), _number("127.255.255.255"))
    low_url = F.lower(url)
    keywords = F.filter(F.array(*[F.lit(k) for k in SUSPICIOUS_KEYWORDS]), lambda k: F.contains(low_url, k))
    c2 = F.filter(
        F.array(*[F.lit(d) for d in C2_DOMAINS]),
        lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)),
    )
    has_credentials = ~F.col("userinfo").isin("", ":")

    def one(condition: Column, text: Column) -> Column:
        return F.when(condition, F.array(text)).otherwise(F.array().cast("array<string>"))

    return urls.withColumns(
        {
            "_c2": c2,
            "_credentials": has_credentials,
            "signals": F.concat(
                one(loopback, F.concat(F.lit("Loopback address ("), host, F.lit(")"))),
                one(private, F.concat(F.lit("Private IP address ("), host, F.lit(") — possible SSRF or internal scan"))),
                one(F.col("tld").isin(*SUSPICIOUS_TLDS), F.concat(F.lit("Suspicious TLD: ."), "tld")),
                F.transform(keywords, lambda k: F.concat(F.lit("URL contains '"), k, F.lit("'"))),
                F.transform(c2, lambda d: F.concat(F.lit("Hostname matches known C2/paste pattern: "), d)),
                one(F.length(url) > LONG_URL, F.concat(F.lit("Unusually long URL ("), F.length(url).cast("string"), F.lit(" chars)"))),
                one(has_credentials, F.lit("URL contains embedded credentials")),
            ),
        }
    ).withColumn(
        "severity", F.when((F.size("_c2") > 0) | F.col("_credentials"), "critical").otherwise("high")
    ).drop("_c2", "_credentials")


def detect_urls(files: DataFrame) -> DataFrame:
    unsafe = with_url_parts(distinct_urls(extract_urls(files))).where(~is_under(F.col("host"), SAFE_HOSTS))
    return as_findings(
        with_signals(unsafe)
        .where(F.size("signals") > 0)
        .select(
            "repo_id",
            "path",
            F.lit("N11").alias("rule_id"),
            "severity",
            F.lit("medium").alias("confidence"),
            F.lit("c2_callback").alias("category"),
            F.lit("Suspicious external URL detected").alias("title"),
            F.array_join("signals", "; ").alias("description"),
            "line_no",
            F.col("url").alias("raw_value"),
        ),
        "url_network",
    )


def detect_network_calls(files: DataFrame) -> DataFrame:
    return match_content(files, network.RULES)
