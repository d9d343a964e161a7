"""DuckDB SQL equal to each registered query (the correctness oracle).

The text is built from small column lists; each statement runs on the
driver-registered views of the same Parquet tables.  Keys without an entry
(approximate sketches, the full report) are checked on rows only.
"""

from __future__ import annotations

from ..functions.numeric import round_sql
from ..functions.text import FILLER_WORDS
from ..operators.profile import CARDINALITY_LABELS
from .registry import SQL_FILTER, SQL_JOIN, TABLES

STAT_DIGITS = 6

#: The driver's tables and their column types, as DESCRIBE prints them.
TABLE_TYPES = """
region: r_regionkey INTEGER, r_name VARCHAR
nation: n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER
customer: c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR
supplier: s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE
part: p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE
orders: o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR
lineitem: l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP
events: event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR
documents: doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT
embeddings: vec_id BIGINT, embedding FLOAT[], label INTEGER
pages: page_id BIGINT, url VARCHAR, html VARCHAR
benchmark: item_id BIGINT, text VARCHAR
labels: doc_id BIGINT, quality INTEGER, toxic INTEGER
conversations: conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR
"""


def table_columns() -> dict[str, list[tuple[str, str, str]]]:
    """(column, type, "") of every table."""
    lines = (ln.split(": ", 1) for ln in TABLE_TYPES.strip().splitlines())
    return {t: [(*c.split(" "), "") for c in columns.split(", ")] for t, columns in lines}


def all_tables(section) -> str:
    """``section(table, columns)`` of every table, with a ``table_name`` column first."""
    return union([f"SELECT {lit(t)} AS table_name, * FROM ({section(t, cols)}) x" for t, cols in table_columns().items()])


ORDERS_N = (
    "(SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, "
    "o_orderdate, o_orderpriority FROM orders)"
)
EVENTS_N = "(SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type, value, props FROM events)"
LINEITEM_N = (
    "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
    "nullif(l_discount, 0.0) AS l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem)"
)

# (name, type name, statistics class)
ORDERS_COLS = [
    ("o_orderkey", "BIGINT", "numeric"),
    ("o_custkey", "BIGINT", "numeric"),
    ("o_orderstatus", "VARCHAR", "scalar"),
    ("o_totalprice", "DOUBLE", "numeric"),
    ("o_orderdate", "TIMESTAMP", "temporal"),
    ("o_orderpriority", "VARCHAR", "scalar"),
]
EVENTS_COLS = [
    ("event_id", "BIGINT", "numeric"),
    ("ts", "TIMESTAMP", "temporal"),
    ("user_id", "BIGINT", "numeric"),
    ("event_type", "VARCHAR", "scalar"),
    ("value", "DOUBLE", "numeric"),
    ("props", "VARCHAR", "scalar"),
]
LINEITEM_COLS = [
    ("l_orderkey", "BIGINT", "numeric"),
    ("l_partkey", "BIGINT", "numeric"),
    ("l_suppkey", "BIGINT", "numeric"),
    ("l_linenumber", "INTEGER", "numeric"),
    ("l_quantity", "DOUBLE", "numeric"),
    ("l_extendedprice", "DOUBLE", "numeric"),
    ("l_discount", "DOUBLE", "numeric"),
    ("l_tax", "DOUBLE", "numeric"),
    ("l_returnflag", "VARCHAR", "scalar"),
    ("l_linestatus", "VARCHAR", "scalar"),
    ("l_shipdate", "TIMESTAMP", "temporal"),
]


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r(expr: str, digits: int = STAT_DIGITS) -> str:
    return round_sql(expr, digits)


def pct(part: str, whole: str, digits: int) -> str:
    """Same arithmetic as ``functions.numeric.percent``."""
    return (
        f"(CASE WHEN {whole} > 0 THEN {r(f'CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100.0', digits)} "
        f"ELSE 0.0 END)"
    )


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _null_count(name: str) -> str:
    return f"count(*) FILTER (WHERE {q(name)} IS NULL)"


# ------------------------------------------------------------------ profiling
def null_columns_sql(src: str, cols) -> str:
    parts = []
    for i, (name, tname, _) in enumerate(cols, start=1):
        nc = _null_count(name)
        parts.append(
            f"SELECT {i} AS ordinal, {lit(name)} AS column_name, {lit(tname)} AS dtype, {nc} AS null_count, "
            f"{pct(nc, 'count(*)', 2)} AS null_percentage, "
            f"count({q(name)}) AS non_null_count, count(*) AS row_count FROM {src} t"
        )
    return union(parts)


def null_totals_sql(src: str, cols) -> str:
    n = len(cols)
    nulls = " + ".join(_null_count(c) for c, _, _ in cols)
    return (
        f"SELECT CAST(count(*) * {n} AS BIGINT) AS total_cells, CAST({nulls} AS BIGINT) AS total_nulls, "
        f"{pct(f'({nulls})', f'(count(*) * {n})', 2)} AS total_null_percentage FROM {src} t"
    )


def completeness_sql(src: str, cols) -> str:
    parts = []
    for i, (name, tname, _) in enumerate(cols, start=1):
        nc = _null_count(name)
        raw = f"(CASE WHEN count(*) > 0 THEN CAST({nc} AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 ELSE 0.0 END)"
        parts.append(
            f"SELECT {i} AS ordinal, {lit(name)} AS column_name, {lit(tname)} AS dtype, {nc} AS null_count, "
            f"{r(raw, 1)} AS null_pct, {r(f'100.0 - {raw}', 1)} AS complete_pct, {nc} > 0 AS has_nulls FROM {src} t"
        )
    return union(parts)


def null_severity_sql(src: str, cols) -> str:
    n = len(cols)
    base = null_columns_sql(src, cols)
    total = pct("sum(null_count) OVER ()", f"(max(row_count) OVER () * {n})", 2)
    return (
        "SELECT ordinal, column_name, null_count, null_percentage, "
        "CASE WHEN null_percentage > 20 THEN 'high' WHEN null_percentage > 5 THEN 'medium' ELSE 'low' END AS severity, "
        "CAST(row_number() OVER (ORDER BY null_percentage DESC, ordinal) AS INTEGER) AS rank, "
        f"total_null_percentage, total_null_percentage > 10 AS table_alert, "
        f"{r('100.0 - total_null_percentage', 1)} AS overall_completeness "
        f"FROM (SELECT *, {total} AS total_null_percentage FROM ({base}) b) x"
    )


def _text(name: str, tname: str) -> str:
    if tname == "BOOLEAN":
        return f"CASE WHEN {q(name)} THEN 'True' ELSE 'False' END"
    return f"CAST({q(name)} AS VARCHAR)"


def _top(src: str, name: str, tname: str, what: str) -> str:
    c = q(name)
    sel = _text(name, tname) if what == "value" else "count(*)"
    return f"(SELECT {sel} FROM {src} s WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} DESC LIMIT 1)"


def statistics_sql(src: str, cols, digits: int = STAT_DIGITS) -> str:
    parts = []
    for i, (name, tname, cls) in enumerate(cols, start=1):
        c = q(name)
        num, tmp, top = cls == "numeric", cls == "temporal", cls in ("scalar", "temporal")
        dnull, snull = "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)"
        fields = [
            f"{i} AS ordinal",
            f"{lit(name)} AS column_name",
            f"{lit(tname.upper())} AS dtype",
            "count(*) AS count",
            f"count(DISTINCT {c}) AS unique_count",
            (r(f"avg({c})", digits) if num else dnull) + " AS mean",
            (r(f"stddev_samp({c})", digits) if num else dnull) + " AS std",
            (f"CAST(min({c}) AS DOUBLE)" if num else dnull) + " AS min_num",
            (f"CAST(max({c}) AS DOUBLE)" if num else dnull) + " AS max_num",
            (f"CAST(min({c}) AS VARCHAR)" if tmp else snull) + " AS min_text",
            (f"CAST(max({c}) AS VARCHAR)" if tmp else snull) + " AS max_text",
            (r(f"quantile_cont(CAST({c} AS DOUBLE), 0.5)", digits) if num else dnull) + " AS median",
            (r(f"quantile_cont(CAST({c} AS DOUBLE), 0.25)", digits) if num else dnull) + " AS q25",
            (r(f"quantile_cont(CAST({c} AS DOUBLE), 0.75)", digits) if num else dnull) + " AS q75",
            (_top(src, name, tname, "value") if top else snull) + " AS top_value",
            (_top(src, name, tname, "freq") if top else "CAST(NULL AS BIGINT)") + " AS top_frequency",
        ]
        parts.append("SELECT " + ", ".join(fields) + f" FROM {src} t")
    return union(parts)


def distinct_counts_sql(src: str, cols) -> str:
    return union(
        [
            f"SELECT {i} AS ordinal, {lit(n)} AS column_name, count(*) AS count, count(DISTINCT {q(n)}) AS unique_count FROM {src} t"
            for i, (n, _, _) in enumerate(cols, start=1)
        ]
    )


def numeric_stats_sql(src: str, cols) -> str:
    return union(
        [
            f"SELECT {i} AS ordinal, {lit(n)} AS column_name, {r(f'avg({q(n)})')} AS mean, "
            f"{r(f'stddev_samp({q(n)})')} AS std, CAST(min({q(n)}) AS DOUBLE) AS min_num, "
            f"CAST(max({q(n)}) AS DOUBLE) AS max_num FROM {src} t"
            for i, (n, _, cls) in enumerate(cols, start=1)
            if cls == "numeric"
        ]
    )


def quantiles_sql(src: str, cols) -> str:
    def qc(n, p):
        return r(f"quantile_cont(CAST({q(n)} AS DOUBLE), {p})")

    return union(
        [
            f"SELECT {i} AS ordinal, {lit(n)} AS column_name, {qc(n, 0.25)} AS q25, {qc(n, 0.5)} AS median, "
            f"{qc(n, 0.75)} AS q75 FROM {src} t"
            for i, (n, _, cls) in enumerate(cols, start=1)
            if cls == "numeric"
        ]
    )


def top_values_sql(src: str, cols) -> str:
    return union(
        [
            f"SELECT {i} AS ordinal, {lit(n)} AS column_name, {_top(src, n, t, 'value')} AS top_value, "
            f"{_top(src, n, t, 'freq')} AS top_frequency"
            for i, (n, t, cls) in enumerate(cols, start=1)
            if cls in ("scalar", "temporal")
        ]
    )


def temporal_range_sql(src: str, cols) -> str:
    return union(
        [
            f"SELECT {i} AS ordinal, {lit(n)} AS column_name, CAST(min({q(n)}) AS VARCHAR) AS min_text, "
            f"CAST(max({q(n)}) AS VARCHAR) AS max_text FROM {src} t"
            for i, (n, _, cls) in enumerate(cols, start=1)
            if cls == "temporal"
        ]
    )


def cardinality_sql(src: str, cols, max_categories: int = 20) -> str:
    parts = []
    for i, (n, _, _) in enumerate(cols, start=1):
        u, rows = f"count(DISTINCT {q(n)})", "count(*)"
        cls = (
            f"CASE WHEN {u} = {rows} THEN 'unique' WHEN {u} <= 2 THEN 'binary' "
            f"WHEN {u} <= {max_categories} THEN 'low' ELSE 'high' END"
        )
        label = "CASE " + " ".join(f"WHEN {cls} = {lit(k)} THEN {lit(v)}" for k, v in CARDINALITY_LABELS.items()) + " END"
        raw = f"(CASE WHEN {rows} > 0 THEN CAST({u} AS DOUBLE) / CAST({rows} AS DOUBLE) * 100.0 ELSE 0.0 END)"
        parts.append(
            f"SELECT {i} AS ordinal, {lit(n)} AS column_name, {u} AS unique_count, {r(raw, 1)} AS uniqueness_pct, "
            f"{cls} AS cardinality, {label} AS label FROM {src} t"
        )
    return union(parts)


def value_counts_sql(src: str, column: str, top_n: int = 10) -> str:
    return (
        f"SELECT value, count, {pct('count', f'(SELECT count(*) FROM {src} z)', 2)} AS percentage FROM ("
        f"SELECT {q(column)} AS value, count(*) AS count FROM {src} t GROUP BY 1 "
        f"ORDER BY count DESC, value ASC NULLS LAST LIMIT {top_n}) v"
    )


def correlations_sql(src: str, cols, digits: int = 3) -> str:
    names = [n for n, _, cls in cols if cls == "numeric"]
    parts = []
    for i, a in enumerate(names):
        for b in names[i:]:
            rv = f"(SELECT corr(CAST({q(a)} AS DOUBLE), CAST({q(b)} AS DOUBLE)) FROM {src} t)"
            val = f"CASE WHEN isnan({rv}) THEN NULL ELSE {r(rv, digits)} END"
            parts.append(f"SELECT {lit(a)} AS col1, {lit(b)} AS col2, {val} AS corr")
            if a != b:
                parts.append(f"SELECT {lit(b)} AS col1, {lit(a)} AS col2, {val} AS corr")
    return union(parts)


def correlation_matrix_sql(src: str, cols) -> str:
    names = [n for n, _, cls in cols if cls == "numeric"]
    cells = ", ".join(f"max(corr) FILTER (WHERE col2 = {lit(n)}) AS {q(n)}" for n in names)
    return f'SELECT col1 AS "column", {cells} FROM ({correlations_sql(src, cols)}) c GROUP BY col1'


def strong_correlations_sql(src: str, cols) -> str:
    return (
        "SELECT col1, col2, corr, CASE WHEN corr > 0 THEN 'positive' ELSE 'negative' END AS strength "
        f"FROM ({correlations_sql(src, cols)}) c WHERE abs(corr) > 0.7"
    )


def summarize_exact_sql(src: str, cols) -> str:
    parts = []
    for n, t, cls in cols:
        c = q(n)
        num = cls == "numeric"
        parts.append(
            f"SELECT {lit(n)} AS column_name, {lit(t)} AS column_type, CAST(min({c}) AS VARCHAR) AS min, "
            f"CAST(max({c}) AS VARCHAR) AS max, "
            + (r(f"avg({c})") if num else "CAST(NULL AS DOUBLE)")
            + " AS avg, "
            + (r(f"stddev_samp({c})") if num else "CAST(NULL AS DOUBLE)")
            + f" AS std, count(*) AS count, {pct(_null_count(n), 'count(*)', 2)} AS null_percentage FROM {src} t"
        )
    return union(parts)


# ------------------------------------------------------------------- sources
def list_tables_sql() -> str:
    return union(
        [
            f"SELECT {lit(t)} AS table_name, count(*) AS row_count, "
            f"(SELECT CAST(count(*) AS INTEGER) FROM information_schema.columns WHERE table_name = {lit(t)}) "
            f"AS column_count FROM {t}"
            for t in sorted(TABLES)
        ]
    )


def schema_info_sql() -> str:
    dt = "data_type"
    category = (
        f"CASE WHEN {dt} LIKE '%[]' OR {dt} LIKE 'STRUCT%' OR {dt} LIKE 'MAP%' THEN 'other' "
        f"WHEN {dt} IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') OR {dt} LIKE 'DECIMAL%' "
        f"THEN 'numeric' WHEN {dt} = 'VARCHAR' THEN 'text' "
        f"WHEN {dt} IN ('DATE', 'TIME', 'TIMESTAMP', 'TIMESTAMP WITH TIME ZONE') THEN 'temporal' "
        f"WHEN {dt} = 'BOOLEAN' THEN 'boolean' ELSE 'other' END"
    )
    names = ", ".join(lit(t) for t in TABLES)
    return (
        f"SELECT table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name, {dt} AS dtype, "
        f"is_nullable = 'YES' AS nullable, {category} AS category FROM information_schema.columns "
        f"WHERE table_name IN ({names})"
    )


def overview_sql() -> str:
    return "SELECT count(*) AS row_count, 6 AS column_count, 'orders.parquet' AS file_name, 'parquet' AS file_type, true AS has_bytes FROM orders"


def sample_preview_sql() -> str:
    def cut(expr):
        return f"CASE WHEN length({expr}) > 50 THEN substr({expr}, 1, 50) || '...' ELSE {expr} END"

    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    cells = ", ".join(f"{cut(f'CAST({c} AS VARCHAR)')} AS {c}" for c in cols)
    return (
        f'SELECT CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS "#", {cells} '
        "FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 10) s"
    )


#: Unicode white space and the separators U+001C to U+001F, as a regular-expression class
BLANK = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def curate_sql(text: str) -> str:
    """The transcript clean-up; each filler goes twice, as neighbours share the character between them."""
    out = text
    for w in FILLER_WORDS:
        for _ in range(2):
            out = rf"regexp_replace({out}, '(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])', '\1\2', 'gi')"
    out = f"trim(regexp_replace({out}, '{BLANK}+', ' ', 'g'))"
    out = f"regexp_replace({out}, '{BLANK}+,', ',', 'g')"
    out = f"regexp_replace({out}, ',{BLANK}*,', ',', 'g')"
    out = f"regexp_replace({out}, '^{BLANK}*,{BLANK}*', '')"
    return f"(SELECT CASE WHEN length(r) > 0 THEN upper(r[1]) || r[2:] ELSE {text} END FROM (SELECT {out} AS r))"


def curated(table: str, keys: str) -> str:
    return f"SELECT {keys}, {curate_sql('text')} AS curated_prompt FROM {table}"


def report_sample_sql() -> str:
    cells = ", ".join(
        f"{_cell(n, t)} AS {q(n)}" for n, t, _ in ORDERS_COLS
    )
    return f"SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS row, {cells} FROM (SELECT * FROM {ORDERS_N} o ORDER BY o_orderkey LIMIT 10) s"


def _cell(name: str, type_name: str) -> str:
    return f"CAST({q(name)} AS VARCHAR)"


def report_nulls_sql() -> str:
    return (
        f"SELECT total_cells, total_nulls, total_null_percentage, column_name, null_count, null_percentage, non_null_count "
        f"FROM ({null_columns_sql(ORDERS_N, ORDERS_COLS)}) c, ({null_totals_sql(ORDERS_N, ORDERS_COLS)}) t"
    )


def distinct_typed_sql() -> str:
    typed = "(SELECT CAST(o_totalprice AS DECIMAL(12,2)) AS price, o_orderdate AS at FROM orders)"
    return union(
        [
            f"SELECT 'embeddings' AS table_name, * FROM ({distinct_counts_sql('embeddings', table_columns()['embeddings'])}) a",
            f"SELECT 'orders' AS table_name, * FROM ({distinct_counts_sql(typed, [('price', '', ''), ('at', '', '')])}) b",
        ]
    )


def decimal_stats_sql() -> str:
    cols = [("l_orderkey", "BIGINT", "numeric")] + [(c, "DECIMAL(12,2)", "numeric") for c in ("l_quantity", "l_extendedprice", "l_tax")]
    casts = ", ".join(f"CAST({c} AS DECIMAL(12,2)) AS {c}" for c, _, _ in cols[1:])
    return numeric_stats_sql(f"(SELECT l_orderkey, {casts} FROM lineitem)", cols)


def flatten_stt_sql() -> str:
    no_alt = "turn % 7 = 6"
    transcript = f"CASE WHEN {no_alt} THEN '' ELSE coalesce(text, '') END"
    return (
        f"SELECT conv_id, turn, {transcript} AS transcript, "
        f"CASE WHEN {no_alt} THEN NULL ELSE CAST(conv_id % 100 AS DOUBLE) / 100.0 END AS confidence, "
        "CASE WHEN turn % 3 = 2 THEN 'fr' ELSE 'en' END AS language, "
        "CAST(length(text) AS DOUBLE) / 12.5 AS duration_seconds, "
        f"CASE WHEN length({transcript}) > 0 THEN 'complete' ELSE 'error' END AS status, "
        f"CASE WHEN length({transcript}) > 0 THEN NULL ELSE 'No transcript returned' END AS error "
        "FROM conversations"
    )


ORACLES: dict[str, str] = {
    "scan_parquet": "SELECT * FROM lineitem",
    "scan_csv": "SELECT * FROM orders",
    "scan_json": "SELECT * FROM orders",
    "list_tables": list_tables_sql(),
    "list_database": list_tables_sql(),
    "row_count": "SELECT count(*) AS row_count FROM lineitem",
    "overview": overview_sql(),
    "schema_info": schema_info_sql(),
    "sample_rows": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
    "sample_preview": sample_preview_sql(),
    "distinct_counts": distinct_counts_sql(LINEITEM_N, LINEITEM_COLS),
    "numeric_stats": numeric_stats_sql(LINEITEM_N, LINEITEM_COLS),
    "quantiles": quantiles_sql(LINEITEM_N, LINEITEM_COLS),
    "top_values": top_values_sql(ORDERS_N, ORDERS_COLS),
    "temporal_range": temporal_range_sql(EVENTS_N, EVENTS_COLS),
    "statistics": statistics_sql(ORDERS_N, ORDERS_COLS),
    "null_columns": null_columns_sql(EVENTS_N, EVENTS_COLS),
    "null_totals": null_totals_sql(EVENTS_N, EVENTS_COLS),
    "completeness": completeness_sql(EVENTS_N, EVENTS_COLS),
    "null_severity": null_severity_sql(EVENTS_N, EVENTS_COLS),
    "cardinality": cardinality_sql(ORDERS_N, ORDERS_COLS),
    "value_counts": value_counts_sql(ORDERS_N, "o_orderstatus"),
    "value_counts_priority": value_counts_sql("orders", "o_orderpriority", top_n=3),
    "correlations": correlations_sql(LINEITEM_N, LINEITEM_COLS),
    "correlation_matrix": correlation_matrix_sql(LINEITEM_N, LINEITEM_COLS),
    "strong_correlations": strong_correlations_sql(LINEITEM_N, LINEITEM_COLS),
    "summarize_exact": summarize_exact_sql(LINEITEM_N, LINEITEM_COLS),
    "scan_csv_text": "SELECT * FROM documents",
    "scan_json_nested": "SELECT * FROM embeddings",
    "scan_json_mixed": "SELECT * FROM conversations",
    "report_statistics": statistics_sql(ORDERS_N, ORDERS_COLS),
    "report_nulls": report_nulls_sql(),
    "report_sample": report_sample_sql(),
    "nulls_all_tables": all_tables(completeness_sql),
    "cardinality_all_tables": all_tables(cardinality_sql),
    "numeric_stats_decimal": decimal_stats_sql(),
    "distinct_counts_typed": distinct_typed_sql(),
    "curate_transcripts": curated("conversations", "conv_id, turn"),
    "curate_stream": curated("conversations", "conv_id, turn"),
    "curate_documents": curated("documents", "doc_id"),
    "transcribe_results": (
        "SELECT conv_id, turn, transcript, CASE WHEN status = 'complete' THEN curated END AS curated_prompt, confidence, language, "
        f"duration_seconds, status FROM (SELECT *, {curate_sql('transcript')} AS curated FROM ({flatten_stt_sql()}) f) g"
    ),
    "sql_filter": SQL_FILTER,
    "sql_join": SQL_JOIN,
    "grouped_average": (
        f"SELECT l_returnflag, {r('avg(l_extendedprice)')} AS avg_l_extendedprice, count(*) AS row_count "
        "FROM lineitem GROUP BY l_returnflag"
    ),
    "pair_correlation": (
        "SELECT 'l_quantity' AS col1, 'l_extendedprice' AS col2, "
        f"{r('corr(l_quantity, l_extendedprice)', 6)} AS corr FROM lineitem"
    ),
    "filtered_summary": statistics_sql(
        f"(SELECT * FROM {ORDERS_N} o WHERE o_orderdate >= TIMESTAMP '1996-01-01' "
        "AND o_orderdate < TIMESTAMP '1997-01-01')",
        ORDERS_COLS,
    ),
    "flatten_stt": flatten_stt_sql(),
}
