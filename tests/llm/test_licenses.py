"""Operator 5 against a plain reading of every text with Python's expressions."""

import re

from calibrium.llm.license_rules import rules
from calibrium.llm.licenses import BASE, CERTAINTY, op5_license_signatures, scan_licenses

RULES = [(k, label, p, re.compile(f"(?<= )(?:{x})(?= )")) for k, label, p, _, x in rules()]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    plain = " " + " ".join(words) + " "
    hits = sorted((m.start(), -m.end(), p, k, label) for k, label, p, x in RULES for m in x.finditer(plain))
    left = [h for i, h in enumerate(hits) if not any(o[2] <= h[2] and o[1] <= h[1] for o in hits[:i])]
    base = {label for _, label in places}
    score = max([0.0] + [CERTAINTY[h[2]] for h in left] + [CERTAINTY[1]] * bool(base))
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {h[4] for h in left})), score)


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *brute(r.text)) for r in rows)
    assert sorted(map(tuple, op5_license_signatures(spark, sf).collect())) == want
    assert sum(bool(w[6]) for w in want) > 3


def test_notices(spark):
    texts = {
        "Released under the MIT License.": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "see www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
        "All rights\nreserved": "reserved",
        "ACC BY, cc  by": "cc-by",
        "die Arbeit mit dem Hund": "",
    }
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    got = {r.text: r.labels for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()}
    assert {t: got[t] for t in texts if t.startswith(("Rel", "Lic", "SPDX", "see", "All", "ACC", "die"))} == {t: x for t, x in texts.items() if not t.startswith("This")}
    assert {"gpl", "gpl-3.0"} <= set(got["This work is licensed under the GNU General Public License, version 3."].split(","))


def test_odd_rows(spark):
    many = "All rights reserved. x É " * 3000
    texts = [None, "", " .,;", "cc", "cc by", "CCKby cc by", many, "general public license"]
    docs = spark.createDataFrame([(k if k else None, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, score int")
    got = {r.text: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in scan_licenses(docs).collect()}
    assert got == {t: brute(t) for t in texts}
    assert scan_licenses(docs.limit(0)).collect() == []
    assert len(RULES) > 300 and all(keyword in x for *_, keyword, x in rules())


def matches_of(parsed):
    """Strings that an expression matches: every alternative and option at least once."""
    lists = []
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            lists.append([chr(arg)])
        elif op == "NOT_LITERAL":
            lists.append(["x"])
        elif op == "IN":
            lists.append(["x"] if str(arg[0][0]) == "NEGATE" else [chr(v if str(o) == "LITERAL" else v[0]) for o, v in arg])
        elif op == "SUBPATTERN":
            lists.append(matches_of(arg[3]))
        elif op == "BRANCH":
            lists.append([s for x in arg[1] for s in matches_of(x)])
        else:
            assert op == "MAX_REPEAT", op
            low, some = arg[0], matches_of(arg[2])
            lists.append([s * max(low, 1) for s in some] + [""] * (low == 0))
    out = {"".join(x[(n // 7 ** (k % 4)) % len(x)] for k, x in enumerate(lists)) for n in range(50)}
    return sorted(out | {"".join(x[-1] for x in lists)} | {"".join(x[n % len(x)] for x in lists) for n in range(max(map(len, lists), default=1))})


def test_every_rule_alone_in_a_text(spark):
    from re import _parser

    texts = {"LGPL 2.1", "AGPLv3", "CC0 1.0 Universal", "GPLv3", "MPLv2", "Unauthorized copying is strictly prohibited", "may not be copied without written permission", "0BSD", "non-commercial use only", "noncommercial use only"}
    assert all(brute(t)[5] for t in texts)
    for *_, x in rules():
        texts.update(s for s in matches_of(_parser.parse(x)) if re.fullmatch(x, s))
    got = {r.text: r for r in scan_licenses(spark.createDataFrame([(t,) for t in sorted(texts)], "text string")).select("text", "n_words", "n_base", "base_labels", "labels", "score").collect()}
    wrong = [(t, got[t].labels, brute(t)[5]) for t in texts if (got[t].n_words, got[t].n_base, got[t].base_labels, got[t].labels, got[t].score) != (*brute(t)[:2], *brute(t)[4:])]
    assert len(texts) > 1000 and wrong == []


def test_a_text_of_many_notices_takes_little_time(spark):
    """A megabyte of notices: more hits than fit a block of places by far."""
    import time

    n = 40_000
    docs = spark.createDataFrame([(1, "All rights reserved. x \u00c9 " * n)], "doc_id long, text string")
    start = time.time()
    (row,) = scan_licenses(docs).selectExpr("n_base", "first_word", "last_word", "labels", "size(detections) AS n", "detections[1].start AS second", "array_max(detections).start AS last").collect()
    assert time.time() - start < 60
    assert (row.n_base, row.first_word, row.last_word, row.labels) == (n, 0, (n - 1) * 5, "reserved") and row.n >= n
    assert row.second > 0 and row.last == 1 + (n - 1) * len("all rights reserved x \u00c9 ")
