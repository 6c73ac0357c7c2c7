"""Generated, minified, vendored and data files among source files (p1).

Each file's tokens are folded into grammars (see ``grammar``). One rule that makes up most of a file, or a grammar far smaller than the file,
marks the output of a tool; literals that make up most of a file and do not fold mark data; rules that other repositories have too mark
third-party copies, however a few of their lines were changed. Where names are short, a grammar of the characters that is hardly larger than that
of the tokens marks packed code: names and layout say nothing there that the tokens do not.

What tools say of themselves is learned: short rules over the words of comments, known in several repositories, most of whose files fold by
themselves far more often than others, mark the rest of their files as well. No remark counts that the grammars do not bear out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..operators.skew import SMALL, salted_join
from ..session import Stages, shuffle_width, spread
from . import grammar

# Thresholds, the same at every size of input.
SAVED = 62  # tokens that repetition must save to tell anything
REUSE, REUSE_RATIO = 0.55, 0.45  # one rule covers this much, and the grammar is no larger than this share of the file
FOLDED = 0.2  # a grammar this small is repetition whatever its largest rule
COPIED, STRETCH = 0.4, 20  # share of tokens under rules that other repositories have too, and the tokens of such a rule
OWN = 0.9  # share of the shared tokens that only vendored files have besides, in the author's own file
SHORT_NAMES, NAMES = 3.0, 12  # mean length of names that may be packed code, and how many there must be
SPELLED = 1.9  # the most that the grammar of its characters has for each symbol of the grammar of its tokens
LITERAL, LITERAL_CHARS, UNFOLDED = 0.5, 300, 0.92  # share of characters in literals, how many, and how little their characters fold next to random ones
TOLD, CHANCE = 0.3, 0.01  # share of folding files among those with a rule of comments, and how likely chance may make such a rule
#: Tokens of files worked on at once, and characters of a file folded as one; a longer file is cut between tokens into pieces whose figures add up,
#: each piece with its own start of the rules, which is some ten thousandth of it.
BATCH_TOKENS, PIECE_CHARS = 400_000, 8_000_000
#: Rules of comments are broadcast up to so many; more are joined by a shuffle.
FEW = 100_000
# Folders that hold what came from elsewhere.
_VENDORED = r"(?i)(?:^|/)(?:_?vendor(?:ed)?|third[_-]?party|external|extern|deps|node_modules|site-packages|contrib)/"

# possessive, since a literal of millions of characters would keep as many places to go back to
_LEXEMES = r"\"(?:[^\"\\\n]++|\\[\s\S])*+\"|'(?:[^'\\\n]++|\\[\s\S])*+'"
_C_LIKE = re.compile(rf"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|{_LEXEMES}|`(?:[^`\\]++|\\[\s\S])*+`|[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]|\w+")
_HASH = re.compile(rf"\#[^\n]*|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|{_LEXEMES}|[A-Za-z_]\w*|\d[\w.]*|[^\s\w]|\w+")
# Words that carry structure, of all the languages together.
_KEYWORDS = frozenset(
    "as async await break case catch class const continue crate def default del do dyn elif else enum except export extends extern finally fn for from "
    "function global if impl implements import in interface is lambda let loop match mod move mut namespace new not or and pass pub raise readonly ref "
    "return self static struct super switch this throw trait try type typeof unsafe use var void where while with yield true false null None True False".split()
)
_WORDS = re.compile(r"[a-z]+(?:['-][a-z]+)*|[<>@]")
_OTHER, _NUMBER, _STRING, _NAME, _COMMENT = range(5)


class _Vocabulary(dict):
    """Numbers of tokens in order of appearance."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _pieces(text: str, pattern: re.Pattern) -> Iterator[list[str]]:
    """The tokens of the text in pieces of bounded length; no token is cut, however long."""
    if len(text) <= PIECE_CHARS:
        yield pattern.findall(text)
        return
    piece, a = [], 0
    for m in pattern.finditer(text):
        if m.end() - a > PIECE_CHARS and piece:
            yield piece
            piece, a = [], m.start()
        piece.append(m[0])
    yield piece


def _comment_rules(comment: str) -> list[str]:
    """Two and three words of a comment that stand together, each once."""
    w = _WORDS.findall(comment.lower())
    return list(dict.fromkeys([*map(" ".join, zip(w, w[1:])), *map(" ".join, zip(w, w[1:], w[2:]))]))


def _remarks(said: list[list[str]]) -> tuple[list[int], list[int], np.ndarray]:
    """(first comment of each file, first rule of each comment, hashes of the rules); equal comments of a file count once."""
    at, starts, rules = [0], [0], []
    for comments in said:
        for c in dict.fromkeys(comments):
            if found := _comment_rules(c):
                rules += found
                starts.append(len(rules))
        at.append(len(starts) - 1)
    return at, starts, pd.util.hash_array(np.array(rules, dtype=object), categorize=False).view(np.int64) if rules else np.zeros(0, np.int64)


def _measure(owners: list[int], parts: list[list[str]], n_files: int) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Figures per file, added up over its pieces, the anchored rules with their files and sizes, and the comments of each file."""
    vocab = _Vocabulary()
    lengths = np.array([len(p) for p in parts], np.int64)
    ids = np.fromiter(map(vocab.__getitem__, chain.from_iterable(parts)), np.int64, int(lengths.sum()))
    words = np.array(list(vocab), dtype=object)
    kind = np.zeros(len(words), np.int8)
    cls = np.zeros(len(words), np.int64)
    classes: dict[str, int] = {"name": 0, "number": 1, "string": 2}
    size = np.zeros(len(words), np.int64)
    for i, w in enumerate(words):
        h = w[0]
        size[i] = len(w)
        if h.isalpha() or h in "_$":
            kind[i] = _NAME if w not in _KEYWORDS else _OTHER
            cls[i] = 0 if kind[i] == _NAME else classes.setdefault(w, len(classes))
        elif h.isdigit():
            kind[i], cls[i] = _NUMBER, 1
        elif h in "\"'`" and len(w) > 1:
            kind[i], cls[i] = _STRING, 2
        elif len(w) > 1 or h == "#":
            if w[:2] in ("//", "/*") or (h == "#" and len(w) > 1):
                kind[i] = _COMMENT
            else:
                cls[i] = classes.setdefault(w, len(classes))
        else:
            cls[i] = classes.setdefault(w, len(classes))
    piece = np.repeat(np.arange(len(parts)), lengths)
    owner = np.array(owners, np.int64)
    file = owner[piece]
    k = kind[ids]
    code = k != _COMMENT
    n = np.bincount(file[code], minlength=n_files)
    count = lambda mask, weight=None: np.bincount(file[mask], None if weight is None else weight[mask], minlength=n_files)
    width = size[ids].astype(float)
    literal = (k == _NUMBER) | (k == _STRING)
    c_ids, c_piece = cls[ids[code]], piece[code]
    symbols, rules, reuse = grammar.repair(c_ids, c_piece, len(parts))
    in_piece = np.bincount(c_piece, minlength=len(parts))
    hashes = pd.util.hash_array(words, categorize=False)
    rule, rule_piece, rule_size = grammar.anchored(hashes[ids[code]], c_piece, STRETCH)
    whole = rule_size >= STRETCH
    figures = {
        "n_tokens": n,
        "n_names": count(k == _NAME),
        "name_chars": count(k == _NAME, width),
        "literal_chars": count(literal, width),
        "grammar": np.bincount(owner, symbols + 2 * rules, minlength=n_files),
        "reused": np.bincount(owner, reuse * in_piece, minlength=n_files),
    }
    said: list[list[str]] = [[] for _ in range(n_files)]
    for i, f in zip(ids[~code], file[~code]):
        said[f].append(words[i])
    return figures, rule[whole], owner[rule_piece[whole]], rule_size[whole], said


def _codes(text: str) -> np.ndarray:
    return np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1]


def _grammar_sizes(texts: list[np.ndarray]) -> list[float]:
    """The size of the grammar of each sequence, for as many of them at once as a batch holds."""
    out, a = [], 0
    while a < len(texts):
        b, n = a + 1, len(texts[a])
        while b < len(texts) and n + len(texts[b]) <= BATCH_TOKENS:
            n += len(texts[b])
            b += 1
        symbols, rules, _ = grammar.repair(np.concatenate(texts[a:b]), np.repeat(np.arange(b - a), [len(t) for t in texts[a:b]]), b - a)
        out += (symbols + 2.0 * rules).tolist()
        a = b
    return out


def _folds_of_literals(files: list[list[list[str]]]) -> list[float]:
    """How far the characters of the long string literals fold: grammar size by that of random text of the same length and alphabet.

    About 1 for random ones whatever their length and alphabet (random text folds too, the more the longer it is and the fewer characters it
    has); 0 without long ones or where they have one character only. Literals are taken whole, some at once up to ``BATCH_TOKENS`` characters.
    """
    owner, found, random_ = [], [], []
    for i, pieces in enumerate(files):
        long = [x[1:-1] for p in pieces for x in p if len(x) >= 200 and x[0] in "\"'`"]
        random = np.random.default_rng(0)
        a = 0
        while a < len(long):
            b, n = a + 1, len(long[a])
            while b < len(long) and n + len(long[b]) <= BATCH_TOKENS:
                n += len(long[b])
                b += 1
            codes = _codes("".join(long[a:b]))
            alphabet = int(codes.max()) + 1
            owner.append(i)
            found.append(codes if alphabet > 1 else codes[:0])
            random_.append(random.integers(0, max(2, alphabet), len(codes)))
            a = b
    total, expected = np.zeros(len(files)), np.zeros(len(files))
    np.add.at(total, owner, _grammar_sizes(found))
    np.add.at(expected, owner, _grammar_sizes(random_))
    return (total / np.maximum(1, expected)).tolist()


def _spelled(files: list[list[list[str]]]) -> list[float]:
    """Grammar of the characters of the code, without blanks and comments, by the grammar of its tokens."""
    owner, chars, tokens = [], [], []
    for i, pieces in enumerate(files):
        for piece in pieces:
            code = [x for x in piece if x[:2] not in ("//", "/*") and (x[0] != "#" or len(x) == 1)]
            owner.append(i)
            tokens.append(pd.factorize(np.array(code, dtype=object))[0].astype(np.int64))
            chars.append(_codes("".join(code)))
    c, t = np.zeros(len(files)), np.zeros(len(files))
    np.add.at(c, owner, _grammar_sizes(chars))
    np.add.at(t, owner, _grammar_sizes(tokens))
    return (c / np.maximum(1, t)).tolist()


def _where(chosen: np.ndarray, files: list[list[list[str]]], measure, other) -> list:
    """``measure`` of the chosen files, ``other`` for the rest."""
    at = np.flatnonzero(chosen)
    got = dict(zip(at.tolist(), measure([files[i] for i in at])))
    return [got.get(i, other) for i in range(len(files))]


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        texts, exts = f["_content"].tolist(), f["_ext"].tolist()
        a = 0
        while a < len(texts):
            owners, parts, tokens, b = [], [], 0, a
            while b < len(texts) and tokens < BATCH_TOKENS:
                pattern = _HASH if exts[b] == "py" else _C_LIKE
                for found in _pieces(texts[b], pattern):
                    owners.append(b - a)
                    parts.append(found)
                    tokens += len(found)
                b += 1
            fig, rule, owner, size, said = _measure(owners, parts, b - a)
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(b - a + 1))
            rule, size = rule[order].view(np.int64), size[order]
            chars = np.array([max(1, len(t)) for t in texts[a:b]])
            n = np.maximum(1, fig["n_tokens"])
            share = fig["literal_chars"] / chars
            here: list[list[list[str]]] = [[] for _ in range(b - a)]
            for i, found in zip(owners, parts):
                here[i].append(found)
            fold = _where((share >= LITERAL) & (fig["literal_chars"] >= LITERAL_CHARS), here, _folds_of_literals, 0.0)
            names = fig["name_chars"] / np.maximum(1, fig["n_names"])
            spelled = _where((names < SHORT_NAMES) & (fig["n_names"] >= NAMES), here, _spelled, None)
            at, said, hashes = _remarks(said)
            yield pd.DataFrame(
                {
                    "file_id": f["file_id"].iloc[a:b].to_numpy(),
                    "_when": f["_when"].iloc[a:b].to_numpy(),
                    "_vendored": f["_vendored"].iloc[a:b].to_numpy(),
                    "repo": f["repo"].iloc[a:b].to_numpy(),
                    "n_tokens": fig["n_tokens"],
                    "n_names": fig["n_names"],
                    "name_length": names,
                    "spelled": pd.array(spelled, dtype="Float64"),
                    "literal_share": share,
                    "literal_chars": fig["literal_chars"].astype(np.int64),
                    "literal_fold": fold,
                    "grammar_share": fig["grammar"] / n,
                    "rule_reuse": fig["reused"] / n,
                    "remarks": [[hashes[said[k] : said[k + 1]] for k in range(at[i], at[i + 1])] for i in range(b - a)],
                    "rules": [rule[bounds[i] : bounds[i + 1]] for i in range(b - a)],
                    "sizes": [size[bounds[i] : bounds[i + 1]].astype(np.int32) for i in range(b - a)],
                }
            )
            a = b


_SCHEMA = "file_id long, _when long, _vendored boolean, repo string, n_tokens long, n_names long, name_length double, spelled double, literal_share double, literal_chars long, literal_fold double, grammar_share double, rule_reuse double, remarks array<array<long>>, rules array<long>, sizes array<int>"


def _told(feats: DataFrame, stages: Stages) -> DataFrame:
    """t_id of the files with a comment that marks tool output.

    A rule of comments is a mark if it is known in several repositories and its files fold by themselves so much more often than all files do that
    chance does not make such a rule among as many as there are. A comment with a mark counts where all its rules together speak for it: the sum
    of what each says of folding, against the share of all files, is positive.
    """
    each = stages.put(feats.select("file_id", F.col("repo").alias("r"), "folded", F.posexplode("remarks").alias("c", "rules")).select("file_id", "r", "folded", "c", F.explode("rules").alias("rule")))
    per = each.select("file_id", "r", "folded", "rule").distinct().groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_if("folded").alias("k"), F.min("r").alias("a"), F.max("r").alias("b"))
    counts = stages.put(per)
    files, folded = feats.agg(F.count(F.lit(1)), F.count_if("folded")).collect()[0]
    base = max(folded, 0.5) / max(files, 1)
    rest = F.col("n") - F.col("k")
    surprise = F.col("k") * F.log(F.col("k") / (F.col("n") * base)) + F.when(rest > 0, rest * F.log(rest / (F.col("n") * (1 - base)))).otherwise(0.0)
    marks = stages.put(counts.filter("k > 0 and a <> b").filter((F.col("k") / F.col("n") >= max(TOLD, base)) & (surprise > F.log(F.lit(counts.count() / CHANCE)))).select(F.col("rule").alias("m_rule")))
    hit = each.join(F.broadcast(marks), F.col("rule") == F.col("m_rule")) if marks.count() <= FEW else salted_join(each, marks, "rule", "m_rule", F.col("file_id"), "inner")
    comments = hit.select(F.col("file_id").alias("f"), F.col("c").alias("fc")).distinct()
    said = stages.put(each.select("file_id", "c", "rule").join(comments, (F.col("file_id") == F.col("f")) & (F.col("c") == F.col("fc")), "left_semi"))
    says = F.log((F.col("k") + 4 * base) / (F.col("n") + 4) / base)
    weighed = salted_join(said, counts.select(F.col("rule").alias("w_rule"), says.alias("says")), "rule", "w_rule", F.col("file_id"), "inner")
    return weighed.groupBy("file_id", "c").agg(F.sum("says").alias("says")).filter("says > 0").select(F.col("file_id").alias("t_id")).distinct()


def classify(files: DataFrame) -> DataFrame:
    """file_id, the figures of ``_SCHEMA`` without the rules, copied_share, source_id, and origin: ``tool``, ``packed``, ``data``, ``copy`` or ``hand``.

    ``file_id`` must be unique. A null content counts as empty; empty files, and files of comments only, are ``hand`` unless their comments mark
    tool output. Files of unknown extension are read as if their language had C's comments. A null repo is a repository of its own.
    ``source_id`` is, for a file with shared rules, the file that had most of them first (by modified_at, null last, then file_id), itself if it
    is that. Where nearly all that a file shares is found, outside of its repository, in folders of vendored code only, and the file is in
    none, it is its author's own and no copy; where no such folder tells who the author is, all files of the group are copies.
    """
    stages = Stages(files.sparkSession, "handwritten")
    when = F.unix_micros(F.col("modified_at").cast("timestamp")) if "modified_at" in files.columns else F.lit(None).cast("long")
    vendored = F.coalesce(F.col("path").rlike(_VENDORED), F.lit(False)).alias("_vendored")
    rows = files.select("file_id", F.coalesce(when, F.lit((1 << 63) - 1)).alias("_when"), vendored, F.coalesce("repo", F.lit("")).alias("repo"), extension("path").alias("_ext"), F.coalesce("content", F.lit("")).alias("_content"))
    feats = spread(rows, "file_id").mapInPandas(_features, _SCHEMA)
    folded = (F.col("n_tokens") * (1 - F.col("grammar_share")) >= SAVED) & (((F.col("rule_reuse") >= REUSE) & (F.col("grammar_share") <= REUSE_RATIO)) | (F.col("grammar_share") <= FOLDED))
    feats = stages.put(feats.withColumn("folded", folded))
    # who has a rule first, and whether two repositories have it at all, follows from a few sums and extremes, so nothing is gathered
    x = F.explode(F.arrays_zip("rules", "sizes")).alias("x")
    each = feats.select("file_id", F.xxhash64("repo").alias("r"), "_when", "_vendored", x).select("file_id", "r", "_when", "_vendored", F.col("x.rules").alias("rule"), F.col("x.sizes").alias("size"))
    plain = F.when(~F.col("_vendored"), F.col("r"))
    shared = each.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("a"), F.max("r").alias("b"), F.min(plain).alias("pa"), F.max(plain).alias("pb"), F.min(F.struct("_when", "file_id"))["file_id"].alias("first")).filter("a <> b")
    shared = stages.put(shared.select(F.col("rule").alias("s_rule"), "n", (F.col("pa") == F.col("pb")).alias("one_author"), "first"))
    # the rules with more rows than a task has on average, from the counts that are there
    line = max((feats.agg(F.sum(F.size("rules"))).collect()[0][0] or 0) // shuffle_width(files.sparkSession), SMALL)
    hot = {r["s_rule"]: r["n"] for r in shared.filter(F.col("n") > line).select("s_rule", "n").collect()}
    hit = salted_join(each.select("file_id", "rule", "size", "_vendored"), shared.drop("n"), "rule", "s_rule", F.col("file_id"), "inner", (hot, line))
    per = hit.groupBy("file_id", "first").agg(F.sum("size").alias("n"), F.sum(F.when(F.col("one_author") & ~F.col("_vendored"), F.col("size")).otherwise(0)).alias("own"))
    copied = per.groupBy(F.col("file_id").alias("c_id")).agg(F.sum("n").alias("copied"), F.sum("own").alias("own"), F.max(F.struct("n", -F.col("first")))["col2"].alias("_source"))
    out = feats.drop("_when", "_vendored", "rules", "sizes", "remarks").join(copied, F.col("file_id") == F.col("c_id"), "left").join(_told(feats, stages), F.col("file_id") == F.col("t_id"), "left")
    n = F.greatest(F.lit(1), F.col("n_tokens"))
    out = out.withColumns({"copied_share": F.coalesce(F.col("copied"), F.lit(0)) / n, "source_id": -F.col("_source"), "told": F.col("t_id").isNotNull()})
    literal = (F.col("literal_share") >= LITERAL) & (F.col("literal_chars") >= LITERAL_CHARS)
    origin = (
        F.when((F.col("copied_share") >= COPIED) & (F.col("own") < OWN * F.col("copied")), "copy")
        .when(F.col("spelled") <= SPELLED, "packed")
        .when(literal & (F.col("folded") | (F.col("literal_fold") >= UNFOLDED)), "data")
        .when(F.col("folded") | F.col("told"), "tool")
        .otherwise("hand")
    )
    return out.withColumn("origin", origin).drop("c_id", "t_id", "_source", "copied", "own")


def not_handwritten(files: DataFrame) -> DataFrame:
    """file_id, origin of the files that no developer of their repository wrote by hand."""
    return classify(files).filter("origin <> 'hand'").select("file_id", "origin")
