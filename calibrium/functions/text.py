"""Column functions over text: prompts, prefixes, numbers, secrets, free-text JSON."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a number is in a report, and what a secret looks like.
NUMBER = r"\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?%?"
SECRET = r"(?<![A-Za-z0-9])(sk|pk|key|api|ghp|token)[-_][A-Za-z0-9_-]{8,}"
DECISIONS = {"none": "no-call", "one": "one-call", "several": "multi-call"}
#: Names that stand in for capitalised words.
PLACEHOLDERS = ["Ostra", "Velmo", "Tarin", "Quesby", "Morwick", "Pellan", "Zindra"]


def known(value: Column, then) -> Column:
    """then(value), with the value worked out once: what a function of an array's items uses would be, for each item anew."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column) -> Column:
    """Words between blanks; an empty array for null and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def halves(text: Column) -> tuple[Column, Column]:
    """First and second half of the words; the odd word goes to the second."""
    w = words(text)
    half = F.floor(F.size(w) / 2).cast("int")
    return F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, F.size(w)), " ")


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    least = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), least), F.slice(b, F.lit(1), least), lambda x, y: x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, least).cast("int")


def redact(text: Column, secrets: list[str] | None = None) -> Column:
    """Known secrets, then key-shaped tokens, are blotted out."""
    out = text
    for s in secrets or []:
        out = F.replace(out, F.lit(s), F.lit("[redacted]"))
    return F.regexp_replace(out, SECRET, "[redacted]")


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def canonical_number(token: Column) -> Column:
    """A number token without marks and needless zeros, in positional form; null if it is no number that fits 38 digits."""
    bare = F.regexp_replace(token, "[,%]", "")
    value = bare.try_cast("decimal(38,18)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(value, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(value.isNotNull(), trimmed)


def positional(number: Column) -> Column:
    """A number's text without an exponent: every digit that it has, none rounded."""
    parts = lambda k: F.regexp_extract(number, r"^(-?)(\d+)(?:\.(\d*?)0*)?[eE]([-+]?\d+)$", k)
    digits, power = F.concat(parts(2), parts(3)), parts(4).try_cast("int")
    point = F.length(parts(2)) + power  # digits before the point
    small = F.concat(parts(1), F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    large = F.concat(parts(1), F.rpad(digits, point, "0"))
    inner = F.concat(parts(1), F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1))
    return F.when(power.isNull(), number).when(point <= 0, small).when(point >= F.length(digits), large).otherwise(inner)


def verbatim(value: Column) -> Column:
    """A JSON value (variant) as a report shows it: null as a dash, numbers positional, texts as they are, lists item by item."""

    def one(v: Column) -> Column:
        kind, text = F.schema_of_variant(v), v.cast("string")
        return F.when(v.isNull() | (kind == "VOID"), "—").when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), positional(text)).when(kind.rlike("^(OBJECT|ARRAY)"), F.to_json(v)).otherwise(text)

    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), one)
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))).otherwise(one(value))


def tools_line(name: Column, description: Column, params: Column) -> Column:
    return F.concat(name, F.lit(": "), F.coalesce(description, F.lit("")), F.lit(" ("), F.array_join(params, ", "), F.lit(")"))


def tools_block(functions: Column) -> Column:
    """One line for each function (name, description, params)."""
    return F.array_join(F.transform(functions, lambda f: tools_line(f["name"], f["description"], f["params"])), "\n")


def parsed_emission(text: Column) -> Column:
    """First JSON object of a free text as struct(decision, confidence, parse_ok, parse_error).

    It must hold a known decision and a confidence that is a JSON number in [0, 1]; other keys are ignored. The text is
    parsed once, however many of the fields are used.
    """

    def read(body: Column) -> Column:
        parts = F.struct(body.alias("body"), F.try_variant_get(body, "$.decision", "variant").alias("decision"), F.try_variant_get(body, "$.confidence", "variant").alias("confidence"))
        return known(parts, judge)

    def judge(x: Column) -> Column:
        number = F.when(F.schema_of_variant(x["confidence"]).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(x["confidence"], "$", "double"))
        names = F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])
        decision = F.when(F.schema_of_variant(x["decision"]) == "STRING", F.element_at(names, F.try_variant_get(x["decision"], "$", "string")))
        return known(F.struct(x["body"].isNull().alias("none"), F.schema_of_variant(x["body"]).startswith("OBJECT").alias("object"), decision.alias("decision"), number.alias("number")), told)

    def told(x: Column) -> Column:
        number = x["number"]
        error = (
            F.when(F.instr(text, "{") == 0, "no object").when(x["none"], "not JSON").when(~x["object"], "not an object")
            .when(x["decision"].isNull(), "no decision").when(number.isNull() | F.isnan(number) | (number < 0) | (number > 1), "no confidence")
        )
        return known(error, lambda e: F.struct(F.when(e.isNull(), x["decision"]).alias("decision"), F.when(e.isNull(), number).alias("confidence"), e.isNull().alias("parse_ok"), e.alias("parse_error")))

    return known(F.try_parse_json(F.when(F.instr(text, "{") > 0, F.substr(text, F.instr(text, "{")))), read)


#: What a description is cut to, as a share, the least that a cut leaves, and words of the shortest line ": ()".
CUT_TO, LEAST_CUT, LEAST_WORDS = 0.7, 24, 2


def trimmed_tools(functions: Column | str, cap: Column) -> Column:
    """The tools block within `cap` words: the longest description is cut to CUT_TO of it (LEAST_CUT characters at least)
    again and again, then last functions go. A null array is an empty block.

    A fold over as many steps as could be needed: how often each description can be cut, and one for each function.
    A function's line has at least LEAST_WORDS words, so of more functions than `most_tools` the later ones go whatever is
    cut, and before the first of them goes every description is at LEAST_CUT: the fold begins there.
    """
    whole = F.coalesce(F.col(functions) if isinstance(functions, str) else functions, F.array())
    return known(F.struct(whole.alias("whole"), (F.size(whole) > most_tools(cap)).alias("over"), F.greatest(most_tools(cap), F.lit(0)).alias("most")), lambda x: _trimmed(x, cap))


def most_tools(cap: Column) -> Column:
    """Functions that a block of `cap` words can hold at most."""
    return F.floor(cap / LEAST_WORDS).cast("int")


def _trimmed(x: Column, cap: Column) -> Column:
    given = F.when(x["over"], F.slice(x["whole"], F.lit(1), x["most"])).otherwise(x["whole"])
    least = lambda f: x["over"] & (F.length(f["description"]) > LEAST_CUT)
    entries = F.transform(
        given,
        lambda f: F.struct(F.coalesce(f["name"], F.lit("")).alias("name"), F.coalesce(F.when(least(f), F.substring(f["description"], F.lit(1), F.lit(LEAST_CUT))).otherwise(f["description"]), F.lit("")).alias("description"), F.when(least(f), "…").otherwise("").alias("mark"), F.coalesce(f["params"], F.array().cast("array<string>")).alias("params")),
    )
    cuts = F.transform(entries, lambda r: 2 + F.ceil(F.ln(F.greatest(F.length(r["description"]), F.lit(LEAST_CUT)) / LEAST_CUT) / -math.log(CUT_TO)).cast("int"))
    steps = F.aggregate(cuts, F.lit(1), lambda n, x: n + x)

    def shown(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda r: F.concat(r["name"], F.lit(": "), r["description"], r["mark"], F.lit(" ("), F.array_join(r["params"], ", "), F.lit(")"))), "\n")

    def shorter(rows: Column) -> Column:
        def cut(at: Column) -> Column:
            size = F.greatest(F.lit(LEAST_CUT), F.floor(at["longest"] * CUT_TO).cast("int"))
            less = lambda r: F.struct(r["name"].alias("name"), F.substring(r["description"], F.lit(1), size).alias("description"), F.lit("…").alias("mark"), r["params"].alias("params"))
            return F.when(size < at["longest"], F.transform(rows, lambda r, i: F.when(i == at["first"], less(r)).otherwise(r))).otherwise(F.slice(rows, F.lit(1), F.size(rows) - 1))

        lengths = F.transform(rows, lambda r: F.length(r["description"]))
        where = lambda x: F.struct(F.array_max(x).alias("longest"), (F.array_position(x, F.array_max(x)) - 1).alias("first"))
        return known(known(lengths, where), cut)

    fitted = F.aggregate(F.sequence(F.lit(1), steps), entries, lambda rows, _: F.when((F.size(rows) > 0) & (F.size(words(shown(rows))) > cap), shorter(rows)).otherwise(rows), shown)
    return F.when(F.size(given) > 0, fitted).otherwise("")


def twin(text: Column | str) -> Column:
    """Deterministic perturbation: each digit is the next one, each capitalised word after the first a placeholder in turn.

    A replaced word keeps the marks at its end. The turn of a word is its place among those that are replaced.
    """
    names = F.array(*map(F.lit, PLACEHOLDERS))
    capitals = lambda w: F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), lambda i: (i > 0) & F.get(w, i).rlike(r"^\p{Lu}"))

    def changed(places: Column, word: Column, i: Column) -> Column:
        turn = F.array_position(places, i)
        name = F.get(names, ((turn - 1) % len(PLACEHOLDERS)).cast("int"))
        return F.when(turn > 0, F.concat(name, F.regexp_extract(word, r"[^\p{L}\p{N}]*$", 0))).otherwise(F.translate(word, "0123456789", "1234567890"))

    each = lambda w: known(capitals(w), lambda places: F.transform(w, lambda word, i: changed(places, word, i)))
    return F.array_join(known(words(F.col(text) if isinstance(text, str) else text), each), " ")
