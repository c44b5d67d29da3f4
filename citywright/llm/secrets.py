"""An incremental ledger of scanned blobs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: The set of rules; a ledger entry of another version does not stand for this one.
RULE_VERSION = "2"

#: (kind, pattern, capturing group that the least length holds for, that length). Matches are leftmost and do
#: not overlap within a kind; those that are too short are dropped afterwards. The first three are the base.
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,30}PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
]
BASE_KINDS = ("assign", "access", "hex")

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: Matches that are placed one after the other.
LOT = 256


def _once(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind, in code points. What stands between matches, and the matches, give their places.

    Matches are placed in lots, then lots by their sums, so that a text with very many matches does not take their square.
    """
    none = F.array().cast(SPAN)

    def place(lot: Column, begin: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            a = acc["at"] + x["gap"]
            span = F.struct(a.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (a + x["len"]).alias("end"))
            return F.struct((a + x["len"]).alias("at"), F.when(x["size"] >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(lot, F.struct(begin.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    def placed(parts: Column) -> Column:
        lots = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / LOT).cast("int")), lambda k: F.slice(parts, k * LOT + 1, LOT))

        def by_lot(lots: Column) -> Column:
            sums = F.transform(lots, lambda lot: F.aggregate(lot, F.lit(0), lambda n, x: n + x["gap"] + x["len"]))
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))
            begins = F.aggregate(sums, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["begins"], F.array(acc["at"])).alias("begins")), lambda acc: acc["begins"])
            return F.flatten(F.zip_with(lots, begins, place))

        return _once(lots, by_lot)

    def parts(found: Column) -> Column:
        between = F.slice(F.split(text, pattern), 1, F.size(found))
        return F.zip_with(between, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"), F.length(F.regexp_extract(m, pattern, group) if group else m).alias("size")))

    matches = lambda found: F.when(F.size(found) > 0, _once(parts(found), placed)).otherwise(none)
    return F.when(text.rlike(pattern), _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), matches)).otherwise(none)


def find_spans(text: Column) -> Column:
    """All spans of a text by start, then kind in the order of ``RULES``: array of (start, rank, kind, end)."""
    return F.sort_array(F.concat(*[_spans(text, k, *rule) for k, rule in enumerate(RULES)]))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def blob_id(text: Column) -> Column:
    """The content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def addresses(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob) of every row, stored: texts are hashed once for all steps that need addresses."""
    return stored(versions.select(F.col(f"`{id_col}`").alias("id"), blob_id(F.col(f"`{text_col}`")).alias("blob")), "addresses")


def scan_blobs(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, addressed: DataFrame | None = None) -> DataFrame:
    """New ledger entries (blob, rule_version, spans) for each blob that the ledger lacks under this rule version.

    Every distinct unseen text is scanned once, however many paths or versions hold it: the text is fetched from the row
    of its least id, and only then matched. ``ledger`` has at least the columns blob and rule_version; entries of other rule versions
    count for nothing. ``addressed`` are the rows' ``addresses``, where they are known already. Only ids and addresses are grouped, so
    a blob with very many copies is one row after partial aggregation.
    """
    addressed = addresses(versions, id_col, text_col) if addressed is None else addressed
    first = addressed.groupBy("blob").agg(F.min("id").alias("id"), F.count("id").alias("n"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob").distinct(), "blob", "left_anti")
    texts = versions.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # rows that repeat an id can hold another text, and rows without an id a blob that no other row has
    wanted = first.where("n > 0").select("id", F.col("blob").alias("wanted")).hint("shuffle_hash")
    named = texts.join(wanted, "id").select("wanted", blob_id(F.col("text")).alias("blob"), "text").where("blob = wanted").select("blob", "text")
    nameless = texts.where("id is null").select(blob_id(F.col("text")).alias("blob"), "text").join(first.where("n = 0").select("blob"), "blob", "left_semi")
    # a generator of one row: a filter on the spans is not moved below it, where it would scan texts that the ledger has
    scanned = named.unionByName(nameless).select("blob", F.inline(F.array(F.struct(find_spans(F.col("text")).alias("spans")))))
    found = scanned.where(F.size("spans") > 0).dropDuplicates(["blob"]).select("blob", F.lit(RULE_VERSION).alias("rule_version"), "spans")
    none = first.select("blob").join(found.select("blob"), "blob", "left_anti").select("blob", F.lit(RULE_VERSION).alias("rule_version"), F.array().cast(SPAN).alias("spans"))
    return found.unionByName(none)


def findings(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """(doc_id, blob, spans) for each row of ``versions``, from old ledger entries and a scan of unseen blobs.

    ``ledger`` is what earlier calls of ``scan_blobs`` returned, put together. Null text counts as empty and
    has no spans. Repeated rows get a row each; other columns are ignored.
    """
    addressed = addresses(versions, id_col, text_col)
    entries = scan_blobs(versions, id_col, text_col, ledger, addressed)
    if ledger is not None:
        entries = entries.unionByName(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob", "rule_version", "spans"))
    hits = entries.where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    return addressed.join(hits, "blob", "left").select(F.col("id").alias("doc_id"), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each maximal run of overlapping spans replaced by ``mark``."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        add = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, add).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, finish)).otherwise(text)


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with all secrets replaced in its texts, and ``size_col`` set anew where a text changed.

    Findings come from the blob ledger and are joined back by content, so the few texts with a secret decide the
    join's size. All columns stay; null texts stay null.
    """
    hits = scan_blobs(docs, id_col, text_col).where(F.size("spans") > 0).select("blob", "spans")
    # the caller's columns travel in one struct, beside which no name of theirs can clash
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), blob_id(F.col(f"`{text_col}`")).alias("blob")).join(hits, "blob", "left")
    new = held.select("row", F.col("spans").isNotNull().alias("hit"), redacted(F.col(f"row.`{text_col}`"), F.coalesce("spans", F.array().cast(SPAN))).alias("new"))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns}
    out[text_col] = F.col("new")
    if size_col in out:
        out[size_col] = F.when(F.col("hit"), F.length("new").cast(docs.schema[size_col].dataType)).otherwise(F.col(f"row.`{size_col}`"))
    return new.select(*[c.alias(n) for n, c in out.items()])


def oracle_sql() -> str:
    """Counts of the base kinds, the base spans' digest and all spans of ``documents``, as DuckDB SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        p = quoted(pattern)
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, k, gaps, found, vals, {least} AS least FROM (SELECT doc_id, gaps, found, vals, unnest(range(1, len(found) + 1)) AS k FROM "
            f"(SELECT doc_id, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS found, regexp_extract_all(t, {p}, {group}) AS vals FROM d WHERE regexp_matches(t, {p})))"
        )
    size = lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: length(x))), 0)"
    base = ", ".join(quoted(k) for k in BASE_KINDS)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    zeros = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
s AS (SELECT doc_id, rank, kind, {size('gaps[1:k]')} + {size('found[1:k - 1]')} AS a, length(found[k]) AS n FROM m WHERE length(vals[k]) >= least),
j AS (SELECT doc_id, rank, kind, a, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS span FROM s),
g AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY a, rank) FILTER (WHERE kind IN ({base})) AS base, string_agg(span, ',' ORDER BY a, rank) AS spans FROM j GROUP BY doc_id)
SELECT d.doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
