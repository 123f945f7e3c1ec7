"""Secret scans with multipart credential linking, in DataFrame expressions alone.

Base spans are the leftmost non-overlapping matches of three patterns; a match
that is too short is dropped.  Positions come from splitting the text at the
pattern: the lengths of what lies between the matches and of the matches add up.

Weak candidates are parts of a credential that say little alone: identifiers
(``id``), low-entropy keys (``key``) and service addresses (``endpoint``).  Each
kind is matched on its own, so an address holds the identifiers and keys of its
query string, and they link with it and with each other.  An
interval join within a document, on buckets of the parts' scopes, keeps a key
that has an identifier or endpoint in its scope, and an identifier or endpoint
that has a key there; strong ``access`` and ``assign`` spans count as identifier
and key.  It is a semi-join, so pairs are never made.

Defined results: a null text counts as empty; a text without findings has
counts of zero, an empty ``spans`` and the hash of the empty string; repeated
rows are reported each; an empty table gives an empty table; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, stash

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

ID = r"""(?:user(?:name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
KEY = r"""(?:pwd|passphrase|auth|credentials?|private_?key|access_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
ENDPOINT = r"""https?://[^\s"'<>]{4,}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}"""
# WEAK is the kinds merged, for tests of texts in which none overlap.
WEAK = f"(?i)(?:{ID}|{KEY}|{ENDPOINT})"
WEAK_KINDS = {3: f"(?i)(?:{ID})", 4: f"(?i)(?:{KEY})", 5: f"(?i)(?:{ENDPOINT})"}

KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
#: Code points around a part that its complement must touch.
SCOPE = 200
MASK = "[REDACTED]"

#: Items of a block of a fold.
BLOCK = 256

_SPAN = "array<struct<start:int,kind:int,end:int>>"
_MATCH = "struct<start:int,end:int,hit:string>"


def _fold(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], at: int = 0) -> Column:
    """at and out: what ``step(at, item)``, the next at and an array of ``kind``, adds over all items.

    Items are folded in blocks, so that an array that grows is copied for those of its
    block and not for all before it.  ``items`` must be cheap: a column or a lambda's name.
    """
    none, nested = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def within(state: Column, item: Column) -> Column:
        beyond, added = step(state["at"], item)
        return F.struct(beyond.alias("at"), F.concat(state["out"], added).alias("out"))

    def block(state: Column, number: Column) -> Column:
        start = F.struct(state["at"].alias("at"), none.alias("out"))
        return F.aggregate(
            F.slice(items, number * BLOCK + 1, F.lit(BLOCK)), start, within, lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["out"])).alias("out"))
        )

    numbers = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(at).alias("at"), nested.alias("out"))
    return F.aggregate(numbers, start, block, lambda s: F.struct(s["at"].alias("at"), F.flatten(s["out"]).alias("out")))


def _matches(text: Column, pattern: str) -> Column:
    """All matches of the pattern with their positions in code points (end exclusive)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    pairs = F.filter(F.arrays_zip(hits.alias("hit"), gaps.alias("gap")), lambda p: p["hit"].isNotNull())

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        lo = at + pair["gap"]
        hi = lo + F.char_length(pair["hit"])
        return hi, F.array(F.struct(lo.alias("start"), hi.alias("end"), pair["hit"].alias("hit")))

    # a lambda's name for the pairs: the pattern runs once, not for every block
    folded = F.get(F.transform(F.array(pairs), lambda p: _fold(p, _MATCH, step)["out"]), F.lit(0))
    return F.when(text.rlike(pattern), folded).otherwise(F.array().cast(f"array<{_MATCH}>"))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(texts: DataFrame) -> DataFrame:
    """The columns of ``texts`` but its text, with base and weak spans (start, kind number, end)."""
    text = F.col("text")
    assign = F.filter(_matches(text, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= 6)
    found = texts.select(
        "*", _spans(assign, 0).cast(_SPAN).alias("assign"), _spans(_matches(text, ACCESS), 1).cast(_SPAN).alias("access"),
        _spans(_matches(text, HEX), 2).cast(_SPAN).alias("hex"), F.concat(*(_spans(_matches(text, p), k).cast(_SPAN) for k, p in WEAK_KINDS.items())).alias("weak"),
    )
    return found.drop("text")


def link(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row, linked: the weak spans whose complementary part touches their scope."""
    weak = rows.filter(F.size("weak") > 0)
    parts = weak.select("row", F.explode(F.concat("weak", "assign", "access")).alias("s")).select("row", "s.*")
    parts = parts.withColumn("role", F.when(F.col("kind").isin(0, 4), "key").when(F.col("kind").isin(1, 3), "id").otherwise("endpoint"))
    met = F.explode(F.sequence(F.expr(f"start div {scope}"), F.expr(f"end div {scope}")))
    other = parts.select("row", met.alias("bucket"), F.col("start").alias("lo"), F.col("end").alias("hi"), (F.col("role") == "key").alias("is_key"))
    reach = F.sequence(F.expr(f"greatest(start - {scope}, 0) div {scope}"), F.expr(f"(end + {scope}) div {scope}"))
    mine = parts.filter("kind >= 3").withColumn("bucket", F.explode(reach))
    joined = mine.alias("m").join(
        other.alias("o"),
        (F.col("m.row") == F.col("o.row")) & (F.col("m.bucket") == F.col("o.bucket")) & ((F.col("m.role") == "key") != F.col("o.is_key"))
        & (F.col("o.lo") <= F.col("m.end") + scope) & (F.col("o.hi") >= F.col("m.start") - scope),
        "left_semi",
    )
    return joined.groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("linked"))


def find_secrets(docs: DataFrame, with_digest: bool = False) -> DataFrame:
    """One row per document: doc_id, counts of base kinds, base_sha256, spans (text)
    and found (array of start, kind number, end; merged order by start).

    ``with_digest`` adds text_sha256, by which a caller can join the texts again.
    """
    texts = id_text(docs)
    if with_digest:
        texts = texts.withColumn("text_sha256", F.sha2("text", 256))
    rows = stash(scan(texts).withColumn("row", F.monotonically_increasing_id()), "spans")
    linked = link(rows)
    base = F.concat("assign", "access", "hex")
    every = F.array_sort(F.concat(base, F.coalesce("linked", F.array().cast(_SPAN))))
    return rows.join(linked, "row", "left").select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_text_of(base), 256).alias("base_sha256"),
        _text_of(every).alias("spans"), every.alias("found"), *(["text_sha256"] if with_digest else []),
    )


def masked(text: Column, found: Column, mask: str = MASK) -> Column:
    """The text with each maximal run of overlapping spans replaced by the mask."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        gap = F.substring(text, at + 1, F.greatest(s["start"] - at, F.lit(0)))
        return F.greatest(s["end"], at), F.when(s["start"] >= at, F.array(gap, F.lit(mask))).otherwise(F.array().cast("array<string>"))

    folded = F.transform(F.array(_fold(found, "string", step)), lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.char_length(text))))
    return F.get(folded, F.lit(0))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns; found spans in text are masked and n_chars, if
    there, counts the new text."""
    found = find_secrets(docs, with_digest=True).filter(F.size("found") > 0)
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("found").alias("_found")).dropDuplicates(["_id", "_sha"])
    rows = docs.select(F.struct(*docs.columns).alias("_row"), docs["doc_id"].cast("long").alias("_key"), F.sha2(F.coalesce(docs["text"], F.lit("")), 256).alias("_digest"))
    rows = rows.join(found, rows["_key"].eqNullSafe(found["_id"]) & (rows["_digest"] == found["_sha"]), "left")
    text = F.when(F.col("_found").isNotNull(), masked(F.col("_row.text"), F.col("_found"))).otherwise(F.col("_row.text"))
    rows = rows.withColumn("_text", text)
    out = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("_found").isNotNull(), F.char_length("_text").cast(kind)).otherwise(F.col("_row.n_chars"))
    return rows.select(*(out.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))
