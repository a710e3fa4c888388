import math
import random
import re
from collections import Counter, defaultdict

from calibrium.llm import pii as P

DOCS = "doc_id long, text string, spans string, term string"
PLAIN = {  # the patterns as they are stated
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    return {"email": True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def tokens_near(before, after):
    if len(before) > P.REACH:
        before = re.sub(r"\A\S+", "", before[-P.REACH - 1 :], flags=re.ASCII)
    if len(after) > P.REACH:
        after = re.sub(r"\S+\Z", "", after[: P.REACH + 1], flags=re.ASCII)
    kept = [t for t in re.split(r"[ \t\n\x0b\f\r]+", f"{before} {after}") if not re.search("[@0-9]", t)]
    return [w for t in kept for w in WORD.findall(low(t))]


def brute(rows, generalise=P.GENERALISE, remove=P.REMOVE):
    near, contexts, n_c, n_ct, n_t = [], defaultdict(set), Counter(), Counter(), Counter()
    base = []
    for _, text in rows:
        text = text or ""
        n_t.update(WORD.findall(low(text)))
        spans = []
        for k, (kind, pattern) in enumerate(PLAIN.items()):
            hits = list(re.finditer(pattern, text))
            cuts = [0, *(x for m in hits for x in m.span()), len(text)]
            for i, m in enumerate(hits):
                if valid(kind, m[0]):
                    spans.append((m.start(), k, m.end()))
                    entity = kind + (re.sub("[^0-9]", "", m[0]) if kind in ("card", "phone") else low(m[0]))
                    near.append((entity, tokens_near(text[cuts[2 * i] : cuts[2 * i + 1]], text[cuts[2 * i + 2] : cuts[2 * i + 3]])))
        base.append(sorted(spans))
    for entity, words in near:
        n_c[entity] += len(words)
        for w in words:
            n_ct[entity, w] += 1
            contexts[entity, w].add(tuple(words))
    most = {}
    for (entity, w), n in n_ct.items():
        if len(contexts[entity, w]) > 1:
            share = 1 + math.log2(min(1, n / n_t[w])) / max(1e-9, -math.log2(n_c[entity] / n_t.total()))
            most[w] = max(most.get(w, -9), share)
    out = []
    for (doc, text), spans in zip(rows, base):
        more = [(m.start(), 4 + (most[m[0]] >= remove), m.end()) for m in WORD.finditer(low(text or "")) if most.get(m[0], -9) >= generalise]
        every = sorted(spans + [x for x in more if not any(b[0] < x[2] and x[0] < b[2] for b in spans)])
        show = lambda spans: ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        out.append((doc, show(spans), show(every)))
    return sorted(out, key=str)


def same(spark, rows, **more):
    docs = spark.createDataFrame([(d, t, "x", None) for d, t in rows], DOCS).repartition(4)
    got = P.personal_spans(docs, **more).select("doc_id", P.written(P.F.col("base")).alias("base"), P.written(P.F.col("spans")).alias("all"))
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == brute(rows, **more)
    return found


def test_values_against_the_stated_patterns(spark):
    rng = random.Random(2)
    bits = ["ann@mail.example.com", "a@b", "x_y@q.r.s-t.", "4539 1488 0343 6467", "4539148803436467", "+1 (743) 555-3824", "10.0.0.255", "1.2.3.4.5.6.7.8", "256.1.1.1", "00012.1.1.1", "+49", "é", "日本", "\U0001f600", " ", ",", ".", "-", "_", "@", "+", "7", "word", "\n", "%", "(", "12345678901234"]
    same(spark, [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 25)))) for i in range(400)])


def planted():
    rows = [(i, f"the {w} of number {i} stands here " * 3) for i, w in enumerate(["alpha", "beta", "gamma", "delta"] * 30)]
    rows += [(200 + i, f"{w} Zorblax wrote from zed.q@mail.example.com about the {w} matter") for i, w in enumerate(["alpha", "beta", "gamma"] * 10)]
    return rows + [(300, "Zorblax was here, in the alpha house"), (301, "nothing to see"), (302, "a once only hapax@mail.example.com seldomword")]


def test_terms_that_give_a_value_away(spark):
    found = {d: (b, s) for d, b, s in same(spark, planted())}
    assert found[300] == ("", "term:0:7") and found[301] == ("", "") and found[302][0] == found[302][1]
    assert all("term:" not in found[d][1] for d in range(120))


def test_random_corpus_with_low_thresholds(spark):
    rng = random.Random(5)
    words = ["Ann", "bob", "Éva", "日本", "x1", "the", "of", "and", "report"]
    values = ["a@b.cd", "E@F.gh", "10.1.2.3", "+49 170 1234567"]
    rows = [(i % 70, " ".join(rng.choice(values) if rng.random() < 0.08 else rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    same(spark, rows, generalise=0.3, remove=0.6)


def test_odd_rows(spark):
    long = "lorem ipsum " * 2_000 + "at a@b.cd, " * 400
    rows = [(None, "me@you.org"), (None, None), (1, ""), (1, None), (1, ""), (2, "x" * 5_000), (3, "9" * 5_000), (4, "1 " * 3_000), (5, long), (2**63 - 1, "+" * 1000), (6, "q@r.st"), (6, "q@r.st")]
    same(spark, rows)
    same(spark, [])


def test_sanitised_texts(spark):
    docs = spark.createDataFrame([(d, t, "x", None) for d, t in planted()] + [(None, None, None, None), (400, "card 4539 1488 0343 6467, ip 10.0.0.1", "", "")], DOCS)
    got = {r.doc_id: r for r in P.sanitise(docs).collect()}
    assert got[300].sanitised == "[NAME] was here, in the alpha house" and got[301].sanitised == "nothing to see"
    assert got[200].sanitised == "alpha [NAME]   [EMAIL]  the alpha "
    assert got[400].sanitised == "card [CARD], ip [IP]" and got[400].spans == "" and got[None].sanitised == ""
    harsh = {r.doc_id: r.sanitised for r in P.sanitise(docs, remove=0.95).collect()}
    assert harsh[300] == " was here, in the alpha house"


def test_very_long_runs_take_linear_time(spark):
    n = 1_000_000
    rows = [(1, "x" * n), (2, "9" * n), (3, "1 " * n), (4, "a@" * n), (5, "1." * n), (6, "+1-" * n), (7, "lorem ipsum " * 50_000 + "at a@b.cd, " * 20_000)]
    got = {r.doc_id: r.n for r in P.base_values(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).selectExpr("doc_id", "size(spans) AS n").collect()}
    assert got[7] == 20_000 and got[1] == got[2] == got[3] == got[4] == 0
