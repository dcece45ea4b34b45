"""WebAssembly import inventory and the risks it shows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palisade.schema import as_findings

# Fixed values.
MAGIC_HEX = "0061736D"
IMPORT_SECTION = 2
REFERENCES_WITH_HEAP_TYPE = (0x63, 0x64)
DANGEROUS_BY_MODULE = {
    "wasi_snapshot_preview1": [
        "fd_write", "fd_read", "proc_exit", "environ_get", "environ_sizes_get", "args_get", "args_sizes_get",
    ],
    "env": ["emscripten_run_script", "emscripten_async_run_script", "system", "popen", "execve", "fork", "sbrk"],
    "wasi_unstable": ["fd_write", "fd_read", "proc_exit"],
}
DANGEROUS_ANYWHERE = [
    "emscripten_run_script", "emscripten_async_run_script", "system", "popen", "execve", "dlopen", "dlsym",
]
NETWORK = ["connect", "send", "recv", "socket", "bind", "listen", "accept"]


class _Bytes:
    """A stretch of a module that is read front to back and never beyond its end."""

    def __init__(self, view: memoryview):
        self.rest = view

    def take(self, n: int) -> memoryview:
        if n > len(self.rest):
            raise ValueError("it ends early")
        part, self.rest = self.rest[:n], self.rest[n:]
        return part

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self, bits: int = 32) -> int:
        """An unsigned LEB128 number of at most so many bits."""
        value = shift = 0
        while True:
            b = self.byte()
            value |= (b & 127) << shift
            shift += 7
            if not b & 128:
                if value >> bits:
                    raise ValueError("a number is too large")
                return value
            if shift >= bits + 6:
                raise ValueError("a number is too long")

    def block(self) -> memoryview:
        return self.take(self.number())

    def text(self) -> str:
        return bytes(self.block()).decode("utf-8", errors="replace")

    def value_type(self) -> None:
        if self.byte() in REFERENCES_WITH_HEAP_TYPE:
            self.number(40)

    def limits(self) -> None:
        flags = self.byte()
        bits = 64 if flags & 4 else 32
        for _ in range(1 + (flags & 1)):
            self.number(bits)

    def descriptor(self) -> None:
        """What an import is: function, table, memory, global or tag."""
        kind = self.byte()
        if kind == 0:
            self.number()
        elif kind == 1:
            self.value_type()
            self.limits()
        elif kind == 2:
            self.limits()
        elif kind == 3:
            self.value_type()
            self.byte()
        elif kind == 4:
            self.byte()
            self.number()
        else:
            raise ValueError(f"import of unknown kind {kind}")


def _module(data: bytes | None) -> dict[str, object]:
    """Imports with both names, and what is wrong with the module, if anything; what came before the damage counts."""
    found: list[dict[str, str]] = []
    damage = None
    try:
        module = _Bytes(memoryview(data or b""))
        module.take(8)
        while module.rest:
            section, body = module.byte(), _Bytes(module.block())
            if section == IMPORT_SECTION:
                for _ in range(body.number()):
                    origin, name = body.text(), body.text()
                    body.descriptor()
                    if origin and name:
                        found.append({"module": origin, "name": name})
    except ValueError as error:
        damage = str(error)
    return {"imports": found, "damage": damage}


_IMPORT = T.StructType([T.StructField("module", T.StringType()), T.StructField("name", T.StringType())])
_MODULE = T.StructType([T.StructField("imports", T.ArrayType(_IMPORT)), T.StructField("damage", T.StringType())])


@F.pandas_udf(_MODULE)
def read_module(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_module(data) for data in raw], columns=["imports", "damage"])


# Not moved or repeated by the optimizer: a filter on the result must not run the function twice.
read_module = read_module.asNondeterministic()


def _modules(files: DataFrame, raw: str) -> DataFrame:
    """The magic number is tested natively, other files never reach Python."""
    modules = files.where(F.hex(F.substring(F.col(raw), 1, 4)) == MAGIC_HEX).select("repo_id", "path", raw)
    return modules.select("repo_id", "path", read_module(F.col(raw)).alias("_m"))


def wasm_imports(files: DataFrame, raw: str = "raw") -> DataFrame:
    """repo_id, path, ordinal, module, name of every import of every module."""
    return _modules(files, raw).select(
        "repo_id", "path", F.posexplode_outer("_m.imports").alias("ordinal", "_i")
    ).where("_i is not null").select("repo_id", "path", "ordinal", "_i.module", "_i.name")


def wasm_errors(files: DataFrame, raw: str = "raw") -> DataFrame:
    """An error row for each damaged module."""
    return _modules(files, raw).where("_m.damage is not null").select(
        "repo_id", "path", F.lit("wasm").alias("stage"), F.col("_m.damage").alias("reason")
    )


def _is_dangerous(module: Column, name: Column) -> Column:
    verdict = name.isin(*DANGEROUS_ANYWHERE)
    for m, names in DANGEROUS_BY_MODULE.items():
        verdict = verdict | ((module == m) & name.isin(*names))
    return verdict


def import_findings(imports: DataFrame) -> DataFrame:
    full = F.concat("module", F.lit("."), "name")

    def entry(rule_id, condition, severity, confidence, category, title, description):
        return F.when(
            condition,
            F.struct(
                F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"),
                F.lit(category).alias("category"), F.concat(F.lit(title), full).alias("title"),
                F.concat(F.lit("WebAssembly binary imports '"), full, F.lit(description)).alias("description"),
                full.alias("raw_value"),
            ),
        )

    checks = F.array(
        entry("A2", _is_dangerous(F.col("module"), F.col("name")), "critical", "high", "suspicious_js_api",
              "WASM imports dangerous function: ", "', which reaches outside the sandbox."),
        entry("A3", F.col("name").isin(*NETWORK), "high", "medium", "behavioral_network",
              "WASM imports networking function: ", "', which can make network calls."),
    )
    rows = imports.select("repo_id", "path", F.explode_outer(checks).alias("f")).where("f is not null")
    return as_findings(rows.select("repo_id", "path", "f.*"), "wasm_analyzer")


def capability_findings(imports: DataFrame) -> DataFrame:
    """One summary row per module and capability; flags are combined before the shuffle."""
    per_file = imports.groupBy("repo_id", "path").agg(
        F.bool_or(_is_dangerous(F.col("module"), F.col("name"))).alias("executes"),
        F.bool_or(F.col("name").isin(*NETWORK)).alias("connects"),
    )

    def entry(flag, severity, confidence, category, title, description):
        return F.when(
            F.col(flag),
            F.struct(
                F.lit("A4").alias("rule_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"),
                F.lit(category).alias("category"), F.lit(title).alias("title"), F.lit(description).alias("description"),
            ),
        )

    checks = F.array(
        entry("executes", "critical", "high", "behavioral_exec", "WASM module has code execution capabilities",
              "Imports of this module allow running arbitrary code."),
        entry("connects", "high", "medium", "behavioral_network", "WASM module has network capabilities",
              "Imports of this module allow network traffic."),
    )
    rows = per_file.select("repo_id", "path", F.explode_outer(checks).alias("f")).where("f is not null")
    return as_findings(rows.select("repo_id", "path", "f.*"), "wasm_analyzer")


def detect_wasm(files: DataFrame, raw: str = "raw") -> DataFrame:
    imports = wasm_imports(files, raw)
    return import_findings(imports).unionByName(capability_findings(imports))
