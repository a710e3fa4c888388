"""Operator 2, URL filters: rules first, then words of host and path under naive Bayes.

A rule that fits decides. For other urls the names in host and path are split into words by a unigram model (the most
probable way to write a name as words, by Viterbi), and multinomial naive Bayes scores the words.

The unigram model counts the words of all urls that their writers parted (by hyphen, underscore or plus: a whole name may
be several words run together) and adds a fixed word list.
Its size is bounded by the parameter `words`: the most frequent ones are broadcast. Naive Bayes learns from labelled
names: by default the fixed lists below. Urls are judged in one narrow pass; only word counts are shuffled, after each
task has added up its own, so a hot host is no hot key.

Defined results: a null url, or one without ://, has empty host and path, fits no rule and holds no words; so does an
empty host; verdicts without words follow the prior (allow); null ids are kept; repeated rows are judged each for
itself; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrium.llm.common import bounded_batches, read

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
WORDS, LONGEST, PRIOR = 50_000, 24, 0.2
#: Names of sites, as separate words, that teach naive Bayes.
BLOCKED = """
casino win | casino bonus | online casino | best casino slots | free slots jackpot | poker bets | free bets | sports betting odds | live betting
bet win | lucky jackpot win | roulette bonus | gambling tips | cheap pills | buy cheap viagra | cialis online pharmacy | discount pills
pharmacy no prescription | diet pills | weight loss pills | cheap meds | adult x | adult video | adult chat | xxx video | free porn | porn tube
hot sex | sex cam | live cams xxx | nude girls | escort girls | adult dating | hookup now | milf porn tube | payday loan | fast cash loan
easy loans | quick loan now | earn money fast | get rich quick | make money | free money | crypto giveaway | bitcoin doubler | forex profit
free download crack | keygen serial | warez torrent | torrent movies | free movies stream | pirate download | cracked software | replica watches
cheap replica | fake rolex | cheap nike outlet | free iphone | free gift card | win prize | claim prize now | click here win | spam mail
phishing login | malware download | hack account | buy followers | buy likes | cheap seo backlinks | essay writing cheap | fake diploma
ads track | ad tracker | ads server | ad banner click | popup ads | tracking pixel | ads | adserver | tracker
casino | bets | pills | viagra | porn | xxx | adult | sex | loans | jackpot | betting | escort | warez | torrent | slots | poker | gambling
casino | bets | pills | viagra | porn | xxx | adult | sex | loans | jackpot | betting | escort | warez | torrent | slots | poker | gambling
"""
ALLOWED = """
news | daily news | world news | local news today | weather report | science journal | nature research | university library | open university
school education | online learning | history museum | city council | public library | government services | health service | hospital info
medical research | family recipes | cooking recipes | garden club | travel guide | hotel guide | sports club | football results | music review
book review | film review | art gallery | photo album | personal diary | developer docs | code wiki
open source software | linux forum | computer help | support forum | help center | company contact | about us | product catalog | shop
online store | book shop | bank branch | insurance info | job offers | real estate | car review | bike shop | train times | flight info
city map | church community | charity fund | environment agency | energy report | finance news | market report | research paper | data portal
encyclopedia | archive | web mail | image files | news | forum | docs | wiki | help | shop | travel | science | school
"""
#: Common words that help to split names, the more frequent ones first.
COMMON = """
the of and to in for on with by at from is my your our all new best top free online web site net com world home life time day year city house
book news blog shop store game games video music photo food health sport travel tech data cloud mobile phone car love live man woman girl boy kids
family school money cash bank credit card work job jobs business market trade deal deals sale cheap buy sell price gift win play fun cool hot big small
good great super mega ultra pro max plus easy fast quick now here there this that get go up out off over under red blue green black white
gold silver star sun moon sea water fire air land earth north south east west one two three first last next media group team club center
""".split()


def _names(text: str) -> list[list[str]]:
    return [x.split() for x in re.split(r"[|\n]", text) if x.strip()]


class NameWords:
    """Splits lower-case letter runs into words by unigram probabilities."""

    def __init__(self, counts: dict[str, float]):
        total = sum(counts.values())
        self.cost = {w: -math.log(c / total) for w, c in counts.items()}
        self.unknown = math.log(total) + 1
        self.memo: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        if name not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[name] = self._viterbi(name)
        return self.memo[name]

    def _viterbi(self, name: str) -> list[str]:
        """Cheapest path; letters that no word covers form unknown words that cost more the longer they are."""
        best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - LONGEST), end):
                word = name[start:end]
                cost = best[start] + self.cost.get(word, self.unknown + 2.3 * len(word))
                if cost < best[end]:
                    best[end], back[end] = cost, start
        out, at = [], len(name)
        while at:
            out.append(name[back[at] : at])
            at = back[at]
        return out[::-1]


class NaiveBayes:
    """Multinomial, add-one smoothing over the words of either class; unknown words count for neither."""

    def __init__(self, blocked: list[list[str]], allowed: list[list[str]], prior: float = PRIOR):
        b, a = Counter(w for x in blocked for w in x), Counter(w for x in allowed for w in x)
        words, nb, na = b.keys() | a.keys(), sum(b.values()), sum(a.values())
        self.odds = {w: math.log((b[w] + 1) / (nb + len(words))) - math.log((a[w] + 1) / (na + len(words))) for w in words}
        self.prior = math.log(prior / (1 - prior))

    def score(self, words: list[str]) -> float:
        """Log odds of block."""
        return self.prior + math.fsum(self.odds.get(w, 0.0) for w in words)


_RUNS = re.compile(r"[a-z]+")
_PARTED = re.compile(r"[a-z]+(?:[-_+][a-z]+)+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lowered and path, by the first ://; empty where there is none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def unigrams(urls: DataFrame, words: int = WORDS) -> dict[str, float]:
    """Counts of the parted words in the urls (column url), the `words` most frequent, over a fixed list."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for name in _PARTED.findall((url or "").lower()):
                    found.update(w for w in _RUNS.findall(name) if 1 < len(w) <= LONGEST)
            if len(found) > 500_000:
                yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})
                found = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    fixed = [w for x in _names(BLOCKED) + _names(ALLOWED) for w in x]
    table = {w: 100.0 for w in fixed} | {w: 1000.0 / (k + 5) + 20 for k, w in enumerate(COMMON)}
    rows = urls.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(words).collect()
    whole = sum(r.n for r in rows) or 1
    for r in rows:  # the urls weigh as much as the list
        table[r.word] = table.get(r.word, 0.0) + 10_000.0 * r.n / whole
    return table


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, blocked: list[list[str]] | None = None, allowed: list[list[str]] | None = None, id_col: str = "page_id", url_col: str = "url", words: int = WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block by naive Bayes) and words for every row."""
    bounded_batches(pages.sparkSession)
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    counts = unigrams(urls.select("url"), words)
    bayes = NaiveBayes(blocked or _names(BLOCKED), allowed or _names(ALLOWED))
    shared = pages.sparkSession.sparkContext.broadcast((counts, bayes))
    host, path = host_and_path(F.col("url"))
    parsed = urls.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "ruled": verdict})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bayes = shared.value
        splitter = NameWords(counts)
        for batch in batches:
            scores, found = [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                # the last name of a host is its registry, not a word
                names = _RUNS.findall(host.rpartition(".")[0] or host) + _RUNS.findall(path.lower())
                words = [w for n in names for w in splitter.split(n)]
                scores.append(bayes.score(words))
                found.append(words)
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "ruled", "score", "words"])

    kind = urls.schema["page_id"].dataType.simpleString()
    out = parsed.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, ruled string, score double, words array<string>")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score", "words")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))
