"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
#: Iterative queries at full size: no SQL can follow them; tests hold them against brute force.
FULL: dict[str, QueryFn] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql=None`` means no SQL form (rows-only check)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def full_query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES or name in FULL:
            raise ValueError(f"duplicate query {name}")
        FULL[name] = fn
        return fn

    return deco


# ---- DuckDB expression helpers (the oracle side) ---------------------------

WS_RUN = r"[^ \t\n\x0B\f\r]+"


def sql_words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WS_RUN}')"


def sql_wc(x: str) -> str:
    return f"CAST(len({sql_words(x)}) AS BIGINT)"


def sql_ratio(tgt_wc: str, src_wc: str) -> str:
    return f"(CAST({tgt_wc} AS DOUBLE) / (CAST({src_wc} AS DOUBLE) + 1e-9))"


def sql_clean(x: str) -> str:
    """STR1-6 in RE2 (no back-references, no lookbehind)."""
    s = f"regexp_replace({x}, '\\(pause \\d+\\.\\d+\\)', '', 'g')"
    s = f"regexp_replace({s}, ',\\s*,+', ',', 'g')"
    s = f"regexp_replace({s}, '\\.{{2,}}', '.', 'g')"
    s = f"regexp_replace({s}, '!{{2,}}', '!', 'g')"
    s = f"regexp_replace({s}, '\\?{{2,}}', '?', 'g')"
    s = f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"
    s = f"regexp_replace({s}, '([.,!?])', '\\1 ', 'g')"
    return f"array_to_string({sql_words(s)}, ' ')"


def cte(**parts: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items()) + "\n"
