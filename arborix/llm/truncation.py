"""Texts that lost their end (p9).

Two kinds of evidence are combined for every text.

Lengths: per source and unit (characters, bytes) the distribution of lengths is fitted by maximum likelihood under right censoring, with one hazard
per stretch of lengths (events over exposure, the estimate that maximises the censored likelihood). Every length is a candidate limit, whatever
share of the texts is above it or at it: it is one where more texts end than the hazards below and above it and its neighbours let expect by
chance, and the expected number against the found one gives the posterior that a text of that length was censored.

Endings: the inner segments (sentences and lines) of all texts, which are complete since more text follows them, tell how segments that begin alike
end: with which mark and after how many tokens. The last segment of a text is weighed against them and against a cut at a random place; a last word
that the corpus never continues, an open code block or quotation, and code whose parse fails at its very end speak for a cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..extract import js_parser, py_parser, rs_parser, svelte_parser
from ..extract.base import allow_depth
from ..operators.skew import hot_counts_of, salted_join
from ..session import Stages, spread
from .mixing import source_key

# Parameters of the length model: stretch of lengths with one hazard, how far below a limit trimmed texts may end, and how likely chance may make a limit.
STRETCH, BELOW, CHANCE = 64, 4, 0.01
#: Posterior of a text of unknown source at a limit that some source has.
UNKNOWN = 0.6
#: Prior of a loss on the way, and the weight of a mark of omission at a limit.
LOST = 0.04
# Marks that are put where a text was cut.
_MARK = r"(?:\.\.\.|…|\[\.\.\.\]|\[…\]|\[truncated\])$"


def log_odds(p: Column) -> Column:
    """The logarithm of p / (1 - p)."""
    return F.log(p / (1 - p))


def _source(docs: DataFrame) -> Column:
    return F.coalesce(source_key("source"), F.lit(""))


def _surest(x: np.ndarray, c: np.ndarray, e: np.ndarray) -> tuple[int, list[tuple[int, int, float]]] | None:
    """(found, rows of at, limit, posterior) of the surest limit, from the lengths x in order, the number c of texts of each and the number e of
    those that no limit found before has censored; None where chance explains them all."""
    risk = c[::-1].cumsum()[::-1]  # texts at least this long
    sums, more, ends = np.append((c * x)[::-1].cumsum()[::-1], 0), np.append(risk, 0), np.append(0, e.cumsum())

    def stretch(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Events and exposure of the lengths from lo to below hi."""
        a, b = np.maximum(1, lo), np.maximum(1, hi)
        i, j = np.searchsorted(x, a), np.searchsorted(x, b)
        return ends[j] - ends[i], np.maximum(1, sums[i] - (a - 1) * more[i] - sums[j] + (b - 1) * more[j])

    def near(sign: int) -> np.ndarray:
        """The most texts that end in one of the next lengths."""
        most = np.zeros(len(x), np.int64)
        for d in range(1, BELOW + 1):
            k = np.minimum(np.searchsorted(x, x + sign * d), len(x) - 1)
            most = np.maximum(most, np.where(x[k] == x + sign * d, e[k], 0))
        return most

    surely = lambda k: np.maximum(0.0, k - 2 * np.sqrt(k))  # noqa: E731 - a few texts above a limit tell no hazard
    excess = lambda n, m: n * np.log(np.maximum(n, 1) / np.maximum(m, 1e-9)) - (n - m)  # noqa: E731 - log likelihood ratio of a Poisson number
    events, exposure = stretch(x - BELOW - STRETCH, x - BELOW)
    below = (events + 0.5) / exposure
    events, exposure = stretch(x + 1, x + 1 + STRETCH)
    hazard = np.maximum(below, surely(events) / exposure)
    left, right = near(-1), near(1)
    expected = np.maximum(hazard * risk, surely(right))
    # against the neighbours, so that a hump of lengths is none, and against the hazards, among as many candidates as there are lengths
    most = np.maximum(left, right)
    beside = excess(e, (e + most) / 2) + excess(most, (e + most) / 2)
    sure = np.where((e > most) & (e > expected) & (beside > -np.log(CHANCE)), excess(e, expected), 0.0)
    i = int(sure.argmax())
    if sure[i] <= np.log(len(x) / CHANCE):
        return None
    out, lim = [], int(x[i])
    for k in np.flatnonzero((x <= lim) & (x >= lim - BELOW) & (e > 0)):
        # those of the limit itself are censored, so the exposure below it is the uncensored model's
        usual = expected[i] if k == i else hazard[i] * risk[k]
        out.append((int(x[k]), lim, max(0.0, 1 - float(usual) / int(e[k]))))
    return int(e[i]), out


def _limits(h: pd.DataFrame) -> list[tuple[str, int, int, float]]:
    """(unit, at, limit, posterior) from chars, bytes and their number n of texts.

    Limits are taken one by one in the unit in which more texts end at them; those texts are censored in both units from then on, so neither
    unit shows the other's limits again.
    """
    n, free, out = h["n"].to_numpy(np.int64), np.ones(len(h), bool), []
    lengths = {u: h[u].to_numpy(np.int64) for u in ("chars", "bytes")}
    grid = {u: np.unique(v, return_inverse=True) for u, v in lengths.items()}
    total = {u: np.bincount(at, n).astype(np.int64) for u, (_, at) in grid.items()}
    while True:
        got = {u: _surest(x, total[u], np.bincount(at, n * free).astype(np.int64)) for u, (x, at) in grid.items()}
        found = {u: g for u, g in got.items() if g}
        if not found:
            return out
        unit = max(found, key=lambda u: found[u][0])
        rows = found[unit][1]
        out += [(unit, *r) for r in rows]
        lim = rows[0][1]
        free &= (lengths[unit] > lim) | (lengths[unit] < lim - BELOW)


def length_limits(docs: DataFrame) -> DataFrame:
    """source, unit, at, limit, posterior: lengths at which texts of a source were censored, and how surely.

    ``unit`` is ``chars`` or ``bytes``; ``at`` runs from the limit down over the few lengths to which trimmed blanks or a broken character
    shorten a cut text. Only a histogram per source, merged on the map side, meets in one place.
    """
    base = docs.filter(F.col("text").isNotNull() & (F.col("text") != "")).select(_source(docs).alias("source"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.col("text").alias("_t"))
    # a text that was delivered many times is one text
    base = base.withColumn("h", F.xxhash64("_t")).drop("_t").distinct()
    hist = base.groupBy("source", "chars", "bytes").agg(F.count(F.lit(1)).alias("n"))

    def fit(h: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_limits(h), columns=["unit", "at", "limit", "posterior"]).assign(source=h["source"].iloc[0])[["source", "unit", "at", "limit", "posterior"]]

    return hist.groupBy("source").applyInPandas(fit, "source string, unit string, at long, limit long, posterior double")


_LANGUAGES = {
    "py": py_parser.parse,
    "js": lambda t, memo: js_parser.parse(t, jsx=True, memo=memo),
    "tsx": lambda t, memo: js_parser.parse(t, jsx=True, typed=True, memo=memo),
    "ts": lambda t, memo: js_parser.parse(t, typed=True, memo=memo),
    "rs": rs_parser.parse,
    "svelte": svelte_parser.parse,
}
# how a text of code begins, by the language to try first; all are tried unless one accepts
_FIRST = [(re.compile(r"\s*(?:use \w|pub |fn |#!?\[)", re.ASCII), "rs"), (re.compile(r"\s*<script"), "svelte"), (re.compile(r"\s*(?:def |from \S+ import|\"\"\"|import [\w.]+(?:\n| as ))", re.ASCII), "py")]
_QUOTED = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|//[^\n]*|/\*[\s\S]*?\*/|#[^\n]*")


def _broken_end(text: str) -> int:
    """1 where the language that fits a text best fails only at its very end, -1 where a language accepts it, else 0."""
    first = next((x for rx, x in _FIRST if rx.match(text)), None)
    reach = 0
    for name in sorted(_LANGUAGES, key=lambda x: x != first):
        at = min((a for a, _ in _LANGUAGES[name](text, memo=True).faults), default=None)
        if at is None:
            return -1
        reach = max(reach, at)
    # the rest behind the first fault of the best language; an unclosed bracket is reported where it opens
    return 1 if len(text[reach:].strip()) <= 3 or _never_closed(text) else 0


def _never_closed(text: str) -> bool:
    """Whether brackets stand open at the end of a code text."""
    depth = 0
    for c in _QUOTED.sub(" ", text):
        depth += (c in "([{") - (c in ")]}")
    return depth > 0


_BLANKS = " \t\n\x0b\f\r"
_CUT = re.compile(rf"(?<=[.!?])[ \t]+(?=[^{_BLANKS}])|\n+")
_TOKENS = regex.compile(rf"[\p{{L}}\p{{N}}_]+|[^{_BLANKS}\p{{L}}\p{{N}}_]")
_TOKENS_ASCII = re.compile(rf"[A-Za-z0-9_]+|[^{_BLANKS}A-Za-z0-9_]")
_WORDY, _NUMERIC = regex.compile(r"[\p{L}\p{N}_]"), regex.compile(r"\p{N}+")
_DIGITS = re.compile(r"[0-9]+")
_ENDS = re.compile(_MARK)
_FENCE = re.compile(r"(?m)^[ ]*```")
_CODE = re.compile(r"\s*(?:import |from \S+ import|use \w+(?:::|;)|\"\"\"|//|#!?\[|<script|export |pub |function |class |const |def |fn )", re.ASCII)
_TICKED = re.compile(r"(?m)^```")
_OPEN, _SMILE = re.compile(r"\([^()]*$"), re.compile(r"[:;]-?\($")

#: Keys that a task counts before it hands them on.
COUNTED = 200_000
#: Limits are broadcast up to so many rows; more are joined by a shuffle.
LIMITS = 100_000


@lru_cache(maxsize=100_000)
def _shape(first: str, second: str) -> tuple[str, str]:
    f = _DIGITS.sub("0", first)
    return f, f"{f} {_DIGITS.sub('0', second)}"


@lru_cache(maxsize=100_000)
def _end_kind(last: str) -> str:
    return "0" if _NUMERIC.fullmatch(last) else "w" if _WORDY.match(last) else last


def _keys(seg: str, tok: list[str]) -> tuple[str, str, str, int]:
    """k1, k2: how a segment begins; the class of its last token and, without a full stop, its number of tokens (25 and more alike); that number."""
    n = min(len(tok), 25)
    k1, k2 = _shape(tok[0], tok[1] if len(tok) > 1 else "")
    if seg.startswith(("  ", "\t")):
        k1, k2 = ">" + k1, ">" + k2
    kind = _end_kind(tok[-1])
    # where a sentence has its stop, its length tells nothing more
    end = f"… {n}" if kind in ".…]" and _ENDS.search(seg) else "." if kind in (".", "!", "?") else f"{kind} {n}"
    return k1, k2, end, n


def _open_ends(t: str) -> float:
    """The weight of what stands open at the end of a text: a code block, a quotation, a bracket, half a character."""
    odd = len(_FENCE.findall(t)) % 2 == 1
    line = t[t.rfind("\n") + 1 :]
    w = -6.0 if odd else 0.0
    if not odd:
        w -= 3.0 * (line.replace("```", "").count("`") % 2)
        w -= 2.5 * bool(_OPEN.search(line) and not _SMILE.search(line))
    return w - 6.0 * t.endswith("�")


_DOC, _ENDING, _WORD = 0, 1, 2
_READ = "part int, doc_id long, source string, k1 string, k2 string, end string, n long, last string, a long, b long, c long, post double, lim long, marked boolean, w_open double, broken int"
_KINDS = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[k]) for n, k in (x.split() for x in _READ.split(", "))])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of three parts from doc_id, source, text, post, lim.

    ``_DOC``: the last segment of every text with its keys, what stands open there, and how its parse as code ends. ``_ENDING``: how many segments
    with these keys are known to be complete (a), and of texts that no limit cut are segments (b) and last segments (c). ``_WORD``: how often a word
    occurs (a), ends segments (b), and ends texts (c). The last two are counts of a part of the texts and are added up later.
    """
    allow_depth()
    endings: dict[tuple, list[int]] = {}
    vocabulary: Counter = Counter()
    tails: dict[str, list[int]] = {}

    def out(part: int, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        cols = dict(zip(names, zip(*rows))) if rows else {}
        return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()) if f.name == "part" else pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(len(rows), f.type) for f in _KINDS], schema=_KINDS)

    def counted() -> Iterator[pa.RecordBatch]:
        yield out(_ENDING, [(*k, *v) for k, v in endings.items()], ["source", "k1", "k2", "end", "a", "b", "c"])
        yield out(_WORD, [(k, n, *tails.get(k, (0, 0))) for k, n in vocabulary.items()], ["last", "a", "b", "c"])
        endings.clear()
        vocabulary.clear()
        tails.clear()

    for batch in batches:
        docs = []
        for doc_id, source, text, post, lim in zip(*(c.to_pylist() for c in batch.columns)):
            t = text.replace("\r\n", "\n").replace("\r", "\n").rstrip(_BLANKS)
            # a mark of omission belongs to the cut where a limit makes cuts, and to the text elsewhere
            m = _ENDS.search(t) if (post or 0.0) > 0.3 else None
            if m:
                t = t[: m.start()]
            cut = (post or 0.0) > 0.5
            find = (_TOKENS_ASCII if t.isascii() else _TOKENS).findall
            segs = [s for s in _CUT.split(t) if s.strip(" ")]
            for i, seg in enumerate(segs):
                tok = find(seg)
                if not tok:
                    continue
                final = i == len(segs) - 1
                k1, k2, end, n = _keys(seg, tok)
                e = endings.setdefault((source, k1, k2, end), [0, 0, 0])
                # segments that are followed by more text are complete; last ones of texts that no limit cut are so but for few
                whole = not (final and cut)
                e[0] += whole
                if not cut:
                    e[1] += 1
                    e[2] += final
                vocabulary.update(tok)
                if whole and end[0] == "w" and end[1:2] == " ":
                    v = tails.setdefault(tok[-1], [0, 0])
                    v[0] += 1
                    v[1] += final
                if final:
                    code = _CODE.match(t) and not _TICKED.search(t)
                    docs.append((doc_id, source, k1, k2, end, n, tok[-1], post, lim, m is not None, _open_ends(t), _broken_end(t) if code else None))
            if len(endings) + len(vocabulary) > COUNTED:
                yield from counted()
        yield out(_DOC, docs, ["doc_id", "source", "k1", "k2", "end", "n", "last", "post", "lim", "marked", "w_open", "broken"])
    yield from counted()


def _evidence(docs: DataFrame, stages: Stages) -> DataFrame:
    """The rows of ``_read`` of every non-blank text."""
    base = docs.filter(F.col("text").rlike(r"\S")).select("doc_id", _source(docs).alias("source"), "text", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))
    base = spread(base, "doc_id")
    limits = stages.put(length_limits(docs).filter("source <> ''"))
    # a text of unknown source may come from any: the limits of all sources are its candidates
    anyone = limits.filter("at = limit and posterior > 0.9").groupBy("unit", "at").agg(F.max("limit").alias("limit"))
    limits = limits.unionByName(anyone.select(F.lit("").alias("source"), "unit", "at", "limit", F.lit(UNKNOWN).alias("posterior")))
    few = limits.count() <= LIMITS
    for unit in ("chars", "bytes"):
        lim = limits.filter(F.col("unit") == unit).groupBy("source", "at").agg(F.max(F.struct("posterior", "limit")).alias(f"l_{unit}")).withColumnRenamed("at", unit)
        base = base.join(F.broadcast(lim) if few else lim, ["source", unit], "left")
    lim = F.greatest("l_chars", "l_bytes")
    rows = base.select("doc_id", "source", "text", lim["posterior"].alias("post"), lim["limit"].alias("lim"))
    return stages.put(rows.mapInArrow(_read, _READ), split="part")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, source, posterior (of having lost its end), limit (the field limit it seems cut at, or null) for every non-blank text.

    Null, empty and blank texts have lost nothing that could be told and are left out; a null source is a source of its own. Sources count alike
    whatever the case, outer spaces or hyphens. Texts are read once, and only counts and a row of keys per text are shuffled.
    """
    stages = Stages(docs.sparkSession, "truncation")
    read = _evidence(docs, stages)
    p = read.filter(F.col("part") == _DOC).select("doc_id", "source", "k1", "k2", "end", "n", "last", "post", "lim", "marked", "w_open", "broken")
    endings, words = read.filter(F.col("part") == _ENDING), read.filter(F.col("part") == _WORD)
    sep = lambda *c: F.concat_ws("\x01", *c)
    p = p.withColumns({"j_s": sep("source", "end"), "j_1": sep("k1", "end"), "j_2": sep("k2", "end"), "j_p": sep("source", "k1")})
    hot = hot_counts_of(p, ["j_s", "j_1", "j_2", "j_p", "last"])
    total = lambda c, *by: F.sum(c).over(Window.partitionBy(*by))

    # counts of each ending: of all texts, of the source, and of the segments that begin alike; the windows run over sums, a row per key and ending
    of_source = endings.groupBy("source", "end").agg(F.sum("a").alias("c_src"), F.sum("b").alias("b"), F.sum("c").alias("c"))
    of_source = of_source.select(sep("source", "end").alias("r_s"), "c_src", total("c_src", "end").alias("c_any"), total("c_src", "source").alias("t_src"), total("b", "source").alias("s_n"), total("c", "source").alias("s_f"))
    n_all = endings.agg(F.sum("a")).collect()[0][0] or 0
    p = salted_join(p, of_source, "j_s", "r_s", F.col("doc_id"), "left", hot["j_s"]).drop("j_s", "r_s")
    for k, j in (("k1", "j_1"), ("k2", "j_2")):
        alike = endings.groupBy(k, "end").agg(F.sum("a").alias(f"c_{k}")).select(sep(k, "end").alias("r"), f"c_{k}", total(f"c_{k}", k).alias(f"t_{k}"))
        p = salted_join(p, alike, j, "r", F.col("doc_id"), "left", hot[j]).drop(j, "r")
    # which segments end texts of a source at all (an inner line of code does not)
    places = endings.groupBy("source", "k1").agg(F.sum("b").alias("s_all"), F.sum("c").alias("s_fin")).select(sep("source", "k1").alias("r"), "s_all", "s_fin")
    p = salted_join(p, places, "j_p", "r", F.col("doc_id"), "left", hot["j_p"]).drop("j_p", "r")
    # last words: how often the corpus has them at all, and how often at the end of a segment
    seen = words.groupBy("last").agg(F.sum("a").alias("v"), F.sum("b").alias("tails"), F.sum("c").alias("finals")).withColumnRenamed("last", "r")
    p = salted_join(p, seen, "last", "r", F.col("doc_id"), "left", hot["last"]).drop("r")

    at_limit = F.coalesce(F.col("post"), F.lit(0.0))
    own = F.when(at_limit > 0.5, 0).otherwise(1)  # a text's own last segment is among the counts
    less = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)) - own, F.lit(0))
    alpha = 4.0
    p = p.withColumn("p_any", (less("c_any") + 0.5) / (n_all + 50.0)).withColumn("p_src", (less("c_src") + 20 * F.col("p_any")) / (less("t_src") + 20.0))
    for k in ("k1", "k2"):
        p = p.withColumn(f"p_{k}", (less(f"c_{k}") + alpha * F.col("p_src")) / (less(f"t_{k}") + alpha))
    # what a cut at a random character leaves: mostly words, after any number of tokens
    kind = F.substring("end", 1, 1)
    chance = F.when(kind == "w", 0.85 / 14).when(kind == "0", 0.05 / 14).when(F.col("end") == ".", 0.015).otherwise(0.03 / 14)
    clip = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    w_end = clip(F.least(F.log(F.col("p_k1") / chance), F.log(F.col("p_k2") / chance)), -6.5, 5.0)
    # an ending that many texts have word for word but for a word or number is a formula of its own
    formula = less("c_k2") >= 5
    inner = F.col("v") - F.col("finals")
    name = F.col("last").rlike(r"_|\d|\p{Ll}\p{Lu}")
    rate = clip(F.log((F.col("tails") + 0.3) / (F.col("v") + 10.0) / 0.02), -3.0, 0.5)
    w_word = F.when(kind != "w", 0.0).when(inner <= 0, F.when(formula, 0.0).when(name, -0.7).otherwise(-4.0)).otherwise(rate)
    lift = F.log(((F.col("s_fin") + 0.5) / (F.col("s_f") + 1)) / ((F.col("s_all") + 1) / (F.col("s_n") + 2)))
    w_place = F.when(F.col("s_all") < 8, 0.0).otherwise(clip(lift, -3.0, 1.5))
    w_code = F.when(F.col("broken") == 1, -6.0).when(F.col("broken") == -1, 1.0).otherwise(0.0)
    # a mark right at a limit is how that limit cuts
    w_mark = F.when(F.col("marked"), -6.0).otherwise(0.0)
    prior = F.greatest(F.lit(LOST), F.least(at_limit, F.lit(0.9995)))
    p = p.withColumns({"w_end": w_end, "w_word": w_word, "w_place": w_place, "w_code": w_code, "w_mark": w_mark, "prior": prior})
    odds = log_odds(F.col("prior")) - (F.col("w_end") + F.col("w_word") + F.col("w_place") + F.col("w_open") + F.col("w_code") + F.col("w_mark"))
    return p.select("doc_id", "source", (1 / (1 + F.exp(-odds))).alias("posterior"), F.when(at_limit > 0.3, F.col("lim")).alias("limit"), "w_end", "w_word", "w_place", "w_open", "w_code", "w_mark", "prior")


def truncated(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, source, posterior, limit of the texts that more likely than not lost their end."""
    return score(docs).filter(F.col("posterior") > least).select("doc_id", "source", "posterior", "limit")


def rates(docs: DataFrame) -> DataFrame:
    """source, n_texts, n_truncated, n_at_limit, rate: how often each source's texts are cut."""
    s = score(docs).groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("posterior") > 0.5).alias("n_truncated"), F.count_if((F.col("posterior") > 0.5) & F.col("limit").isNotNull()).alias("n_at_limit"))
    return s.withColumn("rate", F.col("n_truncated") / F.col("n_texts"))
