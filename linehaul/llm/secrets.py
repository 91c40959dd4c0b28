"""Secrets in whole texts, and which of them look live by who owns their copies.

Three base kinds are found by patterns. Beside them the operator gathers generic
credential-looking words (long, mixed letters and digits) and hashes every value. Over the
corpus it counts, per hash, the distinct repositories (texts of an owner, so that copies count once) and
owners (sources) that hold it: a value that several owners have was copied from an example, one that
stays with one owner looks live, in however many of its documents. Generic words that look live become
spans of kind ``owned``; base spans stay whatever their count. All spans carry both counts.

All of it is DataFrame code. Every match is marked with a character that no pattern can match and the
text cut there; only lengths and matches are passed on, one row each, and a running sum of the lengths
of a document makes positions of them, so a text of any length and number of matches takes time in
proportion. Distinct owners are counted by grouping on hash, owner and text first, which combines within
each task, so a value with a third of all rows leaves each task as one row per text and owner.

Defined results: null is the empty text. Rows without an owner share one unnamed owner.
Repeated rows count as one repository, and each row gets its own result. A very long text is scanned
whole; its spans are one list in the end. Positions are code points, ends exclusive. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linehaul.llm.stage import staged

# Fixed patterns of the base kinds, with the group that holds the secret and its least length.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Generic words: runs of 20 or more of these characters with a digit, a small and a capital letter.
GENERIC = (r"[A-Za-z0-9+/_-]{20,}", 0, 20)
#: A generic word looks live up to so many owners.
LIVE_OWNERS = 1
KINDS = ["assign", "access", "hex", "owned"]
# Two private-use characters: no pattern matches either; the first is read as the second.
_MARK, _OTHER = "\ue000", "\ue001"
_CUTS = "array<struct<kind: int, at: int, size: bigint, value: string>>"


def _cuts(text: Column, kind: int, pattern: str, group: int) -> Column:
    """The text cut at leftmost, non-overlapping matches: lengths of all pieces and, at odd
    places, which are the matches, their values."""
    pieces = F.split(F.regexp_replace(text, pattern, _MARK + "$0" + _MARK), _MARK, -1)

    def piece(p: Column, at: Column) -> Column:
        value = F.regexp_extract(p, pattern, group) if group else p
        return F.struct(
            F.lit(kind).alias("kind"), at.alias("at"), F.char_length(p).cast("bigint").alias("size"), F.when(at % 2 == 1, value).alias("value")
        )

    return F.when(text.rlike(pattern), F.transform(pieces, piece)).otherwise(F.array().cast(_CUTS))


def _kept(kind: Column, value: Column) -> Column:
    """Whether a match counts, by its kind and value."""
    long = F.char_length(value) >= F.array(*[F.lit(least) for _, _, least in (*BASE.values(), GENERIC)])[kind]
    return long & ((kind < 3) | (value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")))


def cut_texts(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """``(doc, id, owner, text_hash, cuts)`` of every row; ``doc`` tells rows apart."""
    text = F.translate(F.coalesce(docs[text_col], F.lit("")), _MARK, _OTHER)
    rows = docs.select(
        docs[id_col].cast("long").alias("id"), docs[owner_col].cast("string").alias("owner"), text.alias("text")
    )
    kinds = [*BASE.values(), GENERIC]
    cuts = F.concat(*[_cuts(F.col("text"), k, pattern, group) for k, (pattern, group, _) in enumerate(kinds)])
    return rows.select(
        F.monotonically_increasing_id().alias("doc"), "id", "owner", F.xxhash64("text").alias("text_hash"), cuts.alias("cuts")
    )


def candidate_spans(texts: DataFrame) -> DataFrame:
    """``(doc, owner, text_hash, start, kind, stop, value, value_hash)``: base spans, and generic words outside them."""
    pieces = texts.select("doc", "owner", "text_hash", F.inline("cuts")).repartition("doc")
    so_far = Window.partitionBy("doc", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumn("stop", F.sum("size").over(so_far)).withColumn("start", F.col("stop") - F.col("size"))
    found = pieces.where(F.col("value").isNotNull() & _kept(F.col("kind"), F.col("value")))
    # In order of starts a base span overlaps a word if one before it ends within or after, or the next begins before its end.
    left = Window.partitionBy("doc").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    right = Window.partitionBy("doc").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("kind") < 3
    met = (F.max(F.when(base, F.col("stop"))).over(left) > F.col("start")) | (F.min(F.when(base, F.col("start"))).over(right) < F.col("stop"))
    found = found.withColumn("met", F.coalesce(met, F.lit(False))).where(base | ~F.col("met"))
    return found.select("doc", "owner", "text_hash", "start", "kind", "stop", "value", F.sha2("value", 256).alias("value_hash"))


def ownership(spans: DataFrame) -> DataFrame:
    """``(value_hash, repositories, owners)`` of every candidate value of the corpus."""
    by_owner = spans.select("value_hash", "owner", "text_hash").distinct().groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source"
) -> DataFrame:
    """One row a document: ``id``, ``spans`` (start, kind, stop, value, repositories, owners,
    live) in order of start and kind; of the generic words only those that look live."""
    texts = staged(cut_texts(docs, id_col, text_col, owner_col), "secret_cuts")
    spans = staged(candidate_spans(texts), "secret_spans")
    known = spans.join(ownership(spans), "value_hash").withColumn("live", F.col("owners") <= LIVE_OWNERS).where("kind < 3 or live")
    listed = known.groupBy("doc").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "value", "repositories", "owners", "live"))).alias("spans")
    )
    return texts.select("doc", "id").join(listed, "doc", "left").select("id", "spans")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans of every document."""
    out = scan_secrets(docs.select("doc_id", "text", "source"))
    spans = F.coalesce("spans", F.array().cast(out.schema["spans"].dataType))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(some: Column) -> Column:
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    counts = [count(kind) for kind in range(3)]
    return out.withColumn("spans", spans).select(
        F.col("id").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
