"""Language identification of web pages by Bayesian evidence fusion.

Posterior of a page's language  ~  host prior x declared-language likelihood x
tempered text likelihood.

* Text: hashed character trigrams under one multinomial per language, learnt
  from a bounded sample of documents of known language.  The mean log likelihood
  counts as ``EFFECTIVE`` trigrams at most, since neighbouring trigrams are not
  independent; text alone gives a first posterior.
* Declared language (``<html lang>`` or the content-language meta tag): how often
  each language declares what is estimated from the sum of first posteriors.
* Address: language shares of the host, smoothed towards its domain's, those
  towards the address suffix's, those towards all pages'.  All are grouped sums of
  first posteriors (combined map-side, so a host with a third of the pages is
  one row per task); a page's own posterior is taken out of its host's sum.

Edge cases: null or empty html has no text evidence; a url without host counts
as host ''; a language outside the sample's is declared as 'other', none as '';
ties go to the first language in alphabetic order; repeated rows stay and count
each; null ids stay; an empty table gives no rows; without any document of known
language every page's language is '' with confidence 0; an end tag that is missing hides
nothing; further columns are not read."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext.llm.common import parts, stored

BUCKETS = 1 << 15
SAMPLE = 2000
EFFECTIVE = 40
STRENGTH = 20.0  # pseudo-pages of the level above

_FLAGS = re.I | re.A
_HIDDEN = re.compile(r"<(script|style|noscript)\b|<!--", _FLAGS)
_ENDS = {name: re.compile(rf"</{name}\s*>", _FLAGS) for name in ("script", "style", "noscript")} | {"": re.compile("-->")}
_TAG = re.compile(r"<[^>]*>")
_NO_LETTER = re.compile(r"[\W\d_]+")
_HTML, _META = re.compile(r"<html\b", _FLAGS), re.compile(r"<meta\b", _FLAGS)
_LANG = re.compile(r"\slang\s*=\s*[\"']?\s*([a-z]{2,3})\b", _FLAGS)
_HEADER = re.compile("content-language", _FLAGS)
_CONTENT = re.compile(r"content\s*=\s*[\"']?\s*([a-z]{2,3})\b", _FLAGS)


def _shown(page: str) -> str:
    """The page without scripts, styles and comments, in one pass: an end that is not
    found once is not looked for again."""
    out, done, at, endless = [], 0, 0, set()
    while (start := _HIDDEN.search(page, at)) is not None:
        name = (start[1] or "").lower()
        end = None if name in endless else _ENDS[name].search(page, start.end())
        if end is None:
            endless.add(name)
            at = start.start() + 1
        else:
            out.append(page[done : start.start()])
            done = at = end.end()
    return " ".join([*out, page[done:]])


def visible_text(page: str) -> str:
    shown = _shown(page)
    last = shown.rfind(">") + 1  # up to there every tag has an end
    return html.unescape(_TAG.sub(" ", shown[:last]) + shown[last:])


def _tags(page: str, kind: re.Pattern):
    """The insides of tags; what looks like a tag inside another belongs to that one."""
    at = 0
    while (start := kind.search(page, at)) is not None:
        end = page.find(">", start.end())
        at = len(page) if end < 0 else end
        yield page[start.end() : at]


def declared_language(page: str) -> str:
    for tag in _tags(page, _HTML):
        if (found := _LANG.search(tag)) is not None:
            return found[1].lower()
    for tag in _tags(page, _META):
        if (header := _HEADER.search(tag)) is not None and (said := _CONTENT.findall(tag, header.end())):
            return said[-1].lower()
    return ""


def trigrams(text: str) -> np.ndarray:
    """Hashed character trigrams of the words, their ends included."""
    chars = f" {_NO_LETTER.sub(' ', text.lower())} "
    c = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    code = (c[:-2] * 1_000_003 + c[1:-1]) * 1_000_003 + c[2:]
    return (code ^ (code >> 17)) % BUCKETS


class TextModel:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.1
        self.logp = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.copy()  # bucket x language

    def log_likelihoods(self, text: str) -> np.ndarray:
        grams = trigrams(text)
        if not len(grams):
            return np.zeros(len(self.languages))
        return self.logp[grams].mean(axis=0) * min(len(grams), EFFECTIVE)


def fit(
    docs: DataFrame, bound: int = SAMPLE, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id"
) -> TextModel:
    """Trigram counts per language over at most ``bound`` documents, chosen by a
    hash of the id; counted where the texts are, one row of counts per language and task."""
    known = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    ).filter("lang is not null and text is not null")
    chosen = known.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(bound)
    sample = known.join(F.broadcast(chosen), "id", "left_semi").select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in parts(batches):
            for lang, text in zip(*(c.to_pylist() for c in b.columns)):
                have = sums.setdefault(lang, np.zeros(BUCKETS))
                have += np.bincount(trigrams(text), minlength=BUCKETS)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "counts"]
            )

    total: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(count, "lang string, counts binary").toLocalIterator():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.counts)
    languages = sorted(total)
    return TextModel(languages, np.array([total[x] for x in languages]).reshape(-1, BUCKETS))


def _normal(logs: Column) -> Column:
    """exp, scaled to sum 1."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _smoothed(counts: Column, n: Column, above: Column) -> Column:
    return F.zip_with(counts, above, lambda c, p: (c + STRENGTH * p) / (n + STRENGTH))


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, declared, text_lang, lang, confidence; one row per page."""
    langs = model.languages
    shared = pages.sparkSession.sparkContext.broadcast(model)
    at_host = F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.lower(at_host).alias("host"), F.col(html_col).cast("string").alias("html"))

    def read(batches):
        for b in parts(batches):
            texts = [x or "" for x in b.column(2).to_pylist()]
            said = [declared_language(x) for x in texts]
            said = [x if x in langs or not x else "other" for x in said]
            logs = [shared.value.log_likelihoods(visible_text(x)).tolist() for x in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(said, pa.string()), pa.array(logs, pa.list_(pa.float64()))],
                names=["page_id", "host", "declared", "logs"],
            )

    read_rows = rows.mapInArrow(read, "page_id long, host string, declared string, logs array<double>")
    if not langs:
        unknown = F.lit("")
        return read_rows.select(
            "page_id", "host", "declared", unknown.alias("text_lang"), unknown.alias("lang"), F.lit(0.0).alias("confidence")
        )
    first = stored(read_rows.withColumn("p", _normal(F.col("logs"))), "first-posteriors")
    n_l = len(langs)

    def sums(df: DataFrame, *by: str) -> DataFrame:
        """Element-wise sums of p and the number of pages."""
        parts = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n_l)]
        n = F.sum("n") if "n" in df.columns else F.count("*")
        out = df.groupBy(*by).agg(*parts, n.cast("double").alias("n"))
        return out.select(*by, F.array(*[f"s{i}" for i in range(n_l)]).alias("p"), "n")

    # declared: at most languages + 2 values, so the table is a literal
    said = {r.declared: np.array(r.p) for r in sums(first, "declared").collect()}
    keys = sorted({*langs, "other", ""})
    table = np.array([said.get(k, np.zeros(n_l)) + 1.0 for k in keys])
    table = np.log(table / table.sum(axis=0))
    likelihood = F.create_map(*[x for k, row in zip(keys, table) for x in (F.lit(k), F.array(*[F.lit(float(v)) for v in row]))])
    everything = np.sum([*said.values(), np.zeros(n_l)], axis=0) + 1.0
    base = F.array(*[F.lit(float(v)) for v in everything / everything.sum()])

    hosts = stored(sums(first, "host"), "hosts").withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    suffix = sums(hosts, "suffix").select("suffix", _smoothed(F.col("p"), F.col("n"), base).alias("p_suffix"))
    domain = sums(hosts, "suffix", "domain").join(suffix, "suffix")
    domain = domain.select("domain", _smoothed(F.col("p"), F.col("n"), F.col("p_suffix")).alias("p_domain"))
    prior = hosts.join(domain, "domain").select("host", F.col("p").alias("sum_p"), F.col("n").alias("n_host"), "p_domain")

    joined = first.join(prior, "host")
    others = F.zip_with("sum_p", "p", lambda s, own: F.greatest(s - own, F.lit(0.0)))
    host_prior = _smoothed(others, F.col("n_host") - 1, F.col("p_domain"))
    logs = F.zip_with(
        F.zip_with("logs", F.transform(host_prior, lambda x: F.log(x)), lambda a, b: a + b),
        likelihood[F.col("declared")],
        lambda a, b: a + b,
    )
    out = joined.withColumn("post", _normal(logs))
    names = F.array(*map(F.lit, langs))
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    return out.select(
        "page_id", "host", "declared", best("p").alias("text_lang"), best("post").alias("lang"),
        F.array_max("post").alias("confidence"),
    )
