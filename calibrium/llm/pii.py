"""Operator 12, personal data: values by pattern, and terms that give such values away by information content.

Values (mail and IP addresses, card and telephone numbers) are found by pattern. Each distinct value is an entity to
protect. A term within `REACH` characters of a value, with no other value of that kind between, is in its context. Over
all words of the corpus let p(c) be the share of words in contexts of entity c, and p(c|t) the share of term t's
occurrences there. The information that t discloses about c is PMI(c; t) = log2(p(c|t) / p(c)), that c holds
IC(c) = -log2 p(c). A term whose PMI is at least `GENERALISE` of IC(c) for some c is generalised to what kind of word it
is, from `REMOVE` on it is removed, wherever it occurs. A term counts only if two different contexts hold it, so that a
value seen once, or copied with its text, says nothing of its neighbours.

Distribution. All is DataFrame functions. One pass over the texts gives values and contexts, which are short; the table
of these is held, and pairs of entity and term are summed with map-side combine. Words are counted over the whole corpus
for terms of such pairs only. Texts are scanned a second time for the terms found; only documents that hold one are
scanned for places. No text is shuffled but of such documents, and of these only when there are too many to broadcast
their keys. Tables are broadcast only when counted and measured to be small (`BROADCAST_BYTES`).

Defined results: a null text is empty; null ids are kept; repeated rows are judged each for itself, and count each for
the corpus; kinds may overlap, and each value counts for its kind; an empty table gives no rows; other columns are
ignored by the query, and `sanitise` keeps them and replaces columns of the names it adds.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrium.llm.common import cut_lineage, join_counted, read, release

REACH, GENERALISE, REMOVE = 64, 0.95, 0.99
BROADCAST_BYTES, BLOCK = 8 << 20, 64
#: The patterns of values, in the order of kinds. Written so that no text costs more than linear time: a
#: match can only begin where a run begins, or right after the match before it.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A part of an address up to 255, digits of cards and telephone numbers.
PART, CARD_DIGITS, PHONE_DIGITS = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])", (14, 19), (10, 15)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kinds by number; terms to generalise and terms to remove are written alike.
KINDS = [*PATTERNS, "term", "term"]
SPAN = "struct<start:int,kind:int,end:int>"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(rf"\A{PART}(?:\.{PART}){{3}}\z")
    if kind == "card":
        return F.length(digits).between(*CARD_DIGITS) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(*PHONE_DIGITS)
    return F.lit(True)


def _found(text: Column, pattern: Column) -> tuple[Column, Column]:
    """Matches, and the stretches between them, one more."""
    return F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, F.lit(-1))


def _places(hits: Column, parts: Column, kind: int) -> Column:
    """array<SPAN> of the matches. An array grows by copying, so places go into blocks and blocks into the whole."""

    def add(acc: Column, k: Column) -> Column:
        start = acc["at"] + F.length(F.get(parts, k))
        end = start + F.length(F.get(hits, k))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))).alias("out"))

    def add_block(acc: Column, begin: Column) -> Column:
        whole = lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"))
        return F.aggregate(F.sequence(begin, F.least(begin + BLOCK, F.size(hits)) - 1), F.struct(acc["at"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), add, whole)

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    found = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1, F.lit(BLOCK)), start, add_block, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _entity(kind: str, hit: Column) -> Column:
    bare = F.regexp_replace(hit, "[^0-9]", "") if kind in ("card", "phone") else F.translate(hit, UPPER, LOWER)
    return F.concat(F.lit(f"{kind}:"), bare)


def _terms(before: Column, after: Column) -> Column:
    """Words within reach; those that the cut goes through and parts of addresses are none."""
    left = F.regexp_replace(F.substring(before, -REACH - 1, REACH + 1), rf"\A\S{{1,{REACH + 1}}}", "")
    left = F.when(F.length(before) > REACH, left).otherwise(before)
    right = F.when(F.length(after) > REACH, F.regexp_replace(F.substring(after, 1, REACH + 1), r"\S+\z", "")).otherwise(after)
    near = F.regexp_replace(F.concat(left, F.lit(" "), right), r"\S*[@0-9]\S*", " ")
    return F.regexp_extract_all(F.translate(near, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _valid_at(kind: str, x: Column) -> Column:
    return _valid(kind, x["hit"])


def _context(kind: str, parts: Column, hit: Column, i: Column) -> Column:
    return F.struct(_entity(kind, hit).alias("entity"), _valid(kind, hit).alias("ok"), _terms(F.get(parts, i), F.get(parts, i + 1)).alias("terms"))


def base_values(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), n_words, spans (array<SPAN> in order) and contexts (entity, terms) of each text."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    out = out.withColumns({"h": F.xxhash64("t"), "n_words": F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))})
    for kind, pattern in PATTERNS.items():
        gate = F.contains("t", F.lit("@")) if kind == "email" else F.contains("t", F.lit("+")) if kind == "phone" else F.col("t").rlike("[0-9]")
        hits, parts = _found(F.col("t"), F.lit(pattern))
        out = out.withColumn(f"hits_{kind}", F.when(gate, hits))
        out = out.withColumn(f"parts_{kind}", F.when(F.size(f"hits_{kind}") > 0, parts))
    out = out.drop("t")
    spans, contexts = [], []
    for number, kind in enumerate(PATTERNS):
        hits, parts = F.col(f"hits_{kind}"), F.col(f"parts_{kind}")
        placed = F.zip_with(_places(hits, parts, number), hits, lambda at, hit: F.struct(at.alias("at"), hit.alias("hit")))
        spans.append(F.transform(F.filter(placed, partial(_valid_at, kind)), lambda x: x["at"]))
        each = F.transform(hits, partial(_context, kind, parts))
        contexts.append(F.transform(F.filter(each, lambda x: x["ok"]), lambda x: F.struct(x["entity"].alias("entity"), x["terms"].alias("terms"))))
    none_s, none_c = F.array().cast(f"array<{SPAN}>"), F.array().cast("array<struct<entity:string,terms:array<string>>>")
    return out.select(
        "doc_id", "h", "n_words", F.sort_array(F.flatten(F.array(*[F.coalesce(s, none_s) for s in spans]))).alias("spans"), F.flatten(F.array(*[F.coalesce(c, none_c) for c in contexts])).alias("contexts")
    )


def _small(rows: DataFrame, text: str) -> bool:
    """Whether rows, measured by their texts, may be broadcast."""
    return (rows.agg(F.coalesce(F.sum(F.length(text).cast("long") * 4 + 64), F.lit(0))).first()[0]) <= BROADCAST_BYTES


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)))


def revealing_terms(docs: DataFrame, values: DataFrame, text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """term, entity, disclosure (share of the entity's information), action: one row per term, for the entity it gives away most."""
    near = values.where(F.size("contexts") > 0).select(F.explode("contexts").alias("c")).select("c.entity", "c.terms", F.xxhash64("c.terms").alias("context"))
    near = cut_lineage(near.groupBy("entity", "terms", "context").agg(F.count("*").alias("copies")))
    sizes = near.groupBy("entity").agg(F.sum(F.size("terms") * F.col("copies")).alias("n_c"))
    pairs = near.select("entity", "context", "copies", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.sum("copies").alias("n_ct"), F.min("context").alias("a"), F.max("context").alias("b"))
    pairs = cut_lineage(pairs.where("a < b").select("entity", "term", "n_ct"))
    terms = cut_lineage(pairs.select("term").distinct())
    words = docs.select(F.explode(F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))).alias("term"))
    if _small(terms, "term"):
        counts = words.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    else:
        counts = words.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term", "left_semi")
    total = values.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    content = -F.log2(F.col("n_c") / F.lit(float(max(1, total))))
    joined = join_counted(pairs.join(counts, "term"), sizes.withColumn("members", F.col("n_c")), ["entity"])
    share = joined.select("entity", "term", (1 + F.log2(F.least(F.lit(1.0), F.col("n_ct") / F.col("n_t"))) / F.greatest(content, F.lit(1e-9))).alias("disclosure"))
    best = share.where(F.col("disclosure") >= generalise).groupBy("term").agg(F.max(F.struct("disclosure", "entity")).alias("x"))
    return best.select("term", "x.entity", "x.disclosure", F.when(F.col("x.disclosure") >= remove, "remove").otherwise("generalise").alias("action"))


def term_spans(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, found (array<SPAN>) of the documents that hold one of the terms (term, action)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    each = texts.select("doc_id", "h", F.explode(_words(F.col("t"))).alias("term"))
    hit = each.join(F.broadcast(terms) if _small(terms, "term") else terms, "term")
    of = lambda action: F.array_join(F.sort_array(F.collect_set(F.when(F.col("action") == action, F.col("term"))), asc=False), "|")
    held = cut_lineage(hit.groupBy("doc_id", "h").agg(of("generalise").alias("general"), of("remove").alias("gone")))
    on = [texts["doc_id"].eqNullSafe(held["doc_id"]), texts["h"] == held["h"]]
    small = _small(held.select(F.concat("general", "gone").alias("x")), "x")
    rows = texts.join(F.broadcast(held) if small else held, on).select(texts["doc_id"], texts["h"], F.translate("t", UPPER, LOWER).alias("t"), "general", "gone")
    for name in ("general", "gone"):
        pattern = F.when(F.col(name) == "", "(?!)").otherwise(F.concat(F.lit(rf"(?<!{WORD[:-1]})(?:"), F.col(name), F.lit(rf")(?!{WORD[:-1]})")))
        hits, parts = _found(F.col("t"), pattern)
        rows = rows.withColumns({f"hits_{name}": hits, f"parts_{name}": parts})
    rows = rows.drop("t")
    places = [_places(F.col(f"hits_{name}"), F.col(f"parts_{name}"), len(PATTERNS) + k) for k, name in enumerate(("general", "gone"))]
    return rows.select("doc_id", "h", F.concat(*places).alias("found")).dropDuplicates(["doc_id", "h"])


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, h, base (array<SPAN>), spans (base and those of revealing terms outside of them) for every row."""
    values = cut_lineage(base_values(docs, id_col, text_col))
    base = values.select("doc_id", "h", F.col("spans").alias("base"))
    terms = cut_lineage(revealing_terms(docs, values, text_col, generalise, remove), 8)
    if terms.isEmpty():
        return base.withColumn("spans", F.col("base"))
    found = cut_lineage(term_spans(docs, terms.select("term", "action"), id_col, text_col))
    small = found.agg(F.coalesce(F.sum(F.size("found") * 16 + 64), F.lit(0))).first()[0] <= BROADCAST_BYTES
    on = [base["doc_id"].eqNullSafe(found["doc_id"]), base["h"] == found["h"]]
    joined = base.join(F.broadcast(found) if small else found, on, "left").select(base["doc_id"], base["h"], "base", "found")
    return joined.select("doc_id", "h", "base", F.sort_array(F.concat("base", F.coalesce(_outside("found", "base"), F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def _outside(found: str, base: str) -> Column:
    """Terms that overlap no value."""
    return F.filter(found, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def written(spans: Column) -> Column:
    """kind:start:end of spans in order, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs with `pii_spans` and `sanitised`: values replaced by their kind, terms by what kind of word they are, or removed."""
    found = personal_spans(docs, id_col, text_col, generalise, remove).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("spans").alias("pii_spans")).dropDuplicates(["__id", "__h"])
    found = cut_lineage(found.where(F.size("pii_spans") > 0))
    rows = docs.drop("pii_spans", "sanitised").withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("__t") == F.col("__h")), "left").drop("__id", "__h")
    spans = F.coalesce("pii_spans", F.array().cast(f"array<{SPAN}>"))
    # what stands before a span begins where those before it have ended
    ends = F.transform(spans, lambda x, i: F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda y: y["end"])), F.lit(0)))
    general = lambda word: F.when(word.rlike(r"\A[A-Z]"), "[NAME]").otherwise("[WORD]")
    shown = lambda x: F.when(x["kind"] == len(PATTERNS), general(F.substring(F.col("__t"), x["start"] + 1, x["end"] - x["start"]))).otherwise(F.get(F.array(*map(F.lit, [*LABELS.values(), "", ""])), x["kind"]))
    piece = lambda x, i: F.concat(F.substring(F.col("__t"), F.get(ends, i) + 1, F.greatest(F.lit(0), x["start"] - F.get(ends, i))), F.when(x["start"] < F.get(ends, i), "").otherwise(shown(x)))
    tail = F.coalesce(F.array_max(F.transform(spans, lambda x: x["end"])), F.lit(0))
    text = F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(F.col("__t"), tail + 1, F.length("__t")))
    return rows.withColumn("sanitised", F.when(F.size(spans) > 0, text).otherwise(F.col("__t"))).withColumn("pii_spans", spans).drop("__t")


def _is_kind(kind: int, x: Column) -> Column:
    return x["kind"] == kind


def op12_information_sanitisation(spark, sf_dir: str) -> DataFrame:
    found = personal_spans(read(spark, sf_dir, "documents"))
    n = [F.size(F.filter("base", partial(_is_kind, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return found.select("doc_id", *n, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
