"""Parts of addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def url_host(url: Column) -> Column:
    """Lower-cased host without user info and port."""
    return F.lower(F.regexp_extract(url, r"(?s)^[A-Za-z]+://(?:[^/?#]*@)?([^/?#:@]*)", 1))


def is_under(host: Column, domains: tuple[str, ...]) -> Column:
    """Host equals one of ``domains`` or lies below one."""
    alternatives = "|".join(d.replace(".", r"\.") for d in domains)
    return host.rlike(rf"(?:^|\.)(?:{alternatives})\z")
