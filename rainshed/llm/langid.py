"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A language is described by the log probabilities of its letter pairs and triples (word ends included) and by the scripts
it is written in. A word is scored for the languages that use its script; moving from one language to another between
two words costs ``SWITCH``. The document's language is that of most letters, its score their share.

The model is fitted on a bounded sample of labelled rows: about ``TRAINING_DOCS`` whole texts of each language, chosen by
hash. Letter sequences under ``LEAST_SHARE`` of a language's are left out, so it holds at most 1 / LEAST_SHARE of each
length: the bound of what is broadcast. Everything else covers all rows and whole texts.

Edge cases: null, empty and letterless texts are ``und`` with score 0, and so is everything if nothing was learned.
Ties go to the language first in order. Words in a script that no learned language uses count for none of them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

TRAINING_DOCS = 3000
LEAST_SHARE = 2e-5
SCRIPT_SHARE = 0.01  # a language uses a script that holds this share of its letters
SWITCH = 10.0
LENGTHS = (2, 3)
WORDS = 1 << 16  # words looked up, learned or scored at a time
UNDETERMINED = "und"
RESULT = "struct<lang:string,score:double,spans:array<struct<start:int,end:int,lang:string>>>"

# Where blocks of scripts begin in Unicode (letters between two of them belong to the former)
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Odia"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Latin"), (0x2C00, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x31F0, "Kana"),
    (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
_STARTS = [s for s, _ in SCRIPTS]
_words = re.compile(r"[^\W\d_]+").findall


def script_of(letter: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]


def _grams(word: str) -> list[str]:
    s = f"<{word}>"
    return [s[i : i + n] for n in LENGTHS for i in range(len(s) - n + 1)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _codes(points: np.ndarray, n: int) -> np.ndarray:
    """A number for each sequence of ``n`` code points, of 21 bits each."""
    out = points[: max(0, len(points) - n + 1)]
    for k in range(1, n):
        out = out << np.uint64(21) | points[k : len(points) - n + 1 + k]
    return out


class Model:
    """Scores of letter sequences by language. ``counts`` holds (language, kind, value, n), kind ``script`` or a length."""

    def __init__(self, counts: list[tuple[str, str, str, int]]):
        self.langs = sorted({c[0] for c in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        scripts: dict[str, np.ndarray] = {}
        seen: dict[str, np.ndarray] = {}
        for lang, kind, value, n in counts:
            into = scripts if kind == "script" else seen
            into.setdefault(value, np.zeros(len(at)))[at[lang]] = n
        letters = sum(scripts.values(), np.zeros(len(at)))
        self.uses = {s: v >= SCRIPT_SHARE * np.maximum(letters, 1) for s, v in scripts.items()}
        self.row = {g: i + 1 for i, g in enumerate(sorted(seen))}
        table = np.array([seen[g] for g in sorted(seen)]).reshape(len(seen), len(at)) + 0.5
        lengths = np.array([len(g) for g in sorted(seen)])
        for n in set(lengths.tolist()):
            table[lengths == n] /= table[lengths == n].sum(0)
        logs = np.log(table) if len(table) else table
        logs -= logs.max(1, keepdims=True) if len(at) else 0
        # sequences overlap, so that a letter counts once for each length
        self.scores = np.vstack([np.zeros((1, len(at))), logs / len(LENGTHS)]).astype(np.float32)
        self._index(sorted(seen))
        self._forget()

    def _index(self, grams: list[str]) -> None:
        """The sequences as numbers, ascending within a length, so that those of many words are sought at once."""
        self.codes: list[tuple[np.ndarray, np.ndarray]] = []
        for n in LENGTHS:
            of_n = [g for g in grams if len(g) == n]
            codes = _codes(_points("".join(of_n)), n)[::n] if of_n else np.empty(0, np.uint64)
            order = codes.argsort()
            self.codes.append((codes[order], np.array([self.row[g] for g in of_n], np.int64)[order]))

    def _forget(self) -> None:
        """No word is known: ``rows`` and ``sizes`` hold scores and length of each known word, with room for more."""
        self.memo: dict[str, int] = {}
        self.rows = np.empty((1024, len(self.langs)), np.float32)
        self.sizes = np.empty(1024, np.int64)

    def _learn(self, words: list[str]) -> None:
        points = _points("".join(f"<{w}>" for w in words))
        sizes = np.array([len(w) for w in words])
        starts = np.cumsum(sizes + 2) - sizes - 2
        rows, shares = [], []
        for n, (codes, row) in zip(LENGTHS, self.codes, strict=True):
            found = np.zeros(len(points), np.int64)
            if len(codes):
                sought = _codes(points, n)
                place = np.minimum(np.searchsorted(codes, sought), len(codes) - 1)
                found[: len(sought)] = np.where(codes[place] == sought, row[place], 0)
            rows.append(found)
            shares.append(sizes + 3 - n)
        # the sequences of a word stand together, those of the first length first
        many = np.array(shares).T.ravel()
        firsts = (starts[:, None] + np.arange(len(LENGTHS)) * len(points)).ravel()
        ends = np.cumsum(many)
        flat = np.concatenate(rows)[np.arange(ends[-1]) + np.repeat(firsts - ends + many, many)]
        new = np.add.reduceat(self.scores[flat], np.concatenate([[0], ends[len(LENGTHS) - 1 : -1 : len(LENGTHS)]]), axis=0)
        for i, w in enumerate(words):
            if w[0] > "˿" and (uses := self.uses.get(script_of(w[0]))) is not None and uses.any():
                new[i, ~uses] -= 100
        known = len(self.memo)
        self.memo.update(zip(words, range(known, known + len(words)), strict=True))
        if len(self.memo) > len(self.rows):  # twice the room, lest every new word copies all
            room = 2 * len(self.memo)
            self.rows = np.concatenate([self.rows[:known], np.empty((room - known, len(self.langs)), np.float32)])
            self.sizes = np.concatenate([self.sizes[:known], np.empty(room - known, np.int64)])
        self.rows[known : len(self.memo)], self.sizes[known : len(self.memo)] = new, sizes

    def score_rows(self, words: list[str]) -> np.ndarray:
        """Positions in ``rows`` of the scores of ``words``."""
        found = list(map(self.memo.get, words))
        if None in found:
            unknown = list({w for w, i in zip(words, found, strict=True) if i is None})
            for at in range(0, len(unknown), WORDS):
                self._learn(unknown[at : at + WORDS])
            found = list(map(self.memo.get, words))
        return np.array(found, dtype=np.int64)

    def label(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The language of every word of several texts: one Viterbi step moves all texts on by a word."""
        if not any(map(len, rows)):
            return rows
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        lengths = np.array([len(rows[i]) for i in order])
        steps = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than the step
        start = np.concatenate([[0], np.cumsum(active)])
        by_step = np.empty(start[-1], np.int64)
        for r, i in enumerate(order):
            by_step[start[: len(rows[i])] + r] = rows[i]
        n = len(self.langs)
        best = np.zeros((n, len(order)), np.float32)  # the highest of a text is always 0
        moved = np.empty((n, start[-1]), bool)
        origin = np.zeros(start[-1], np.int16)
        at, lost = start.tolist(), np.float32(-SWITCH)
        first = 0
        while first < steps:  # a language a row, and the steps of some words at a time
            last = min(max(first + 1, int(np.searchsorted(start, at[first] + WORDS, side="right")) - 1), steps)
            low = at[first]
            scores = np.ascontiguousarray(self.rows[by_step[low : at[last]]].T)
            before = np.empty_like(scores)
            for t in range(first, last):
                a, b = at[t] - low, at[t + 1] - low
                v = best[:, : b - a]
                before[:, a:b] = v
                np.maximum(v, lost, out=v)
                v += scores[:, a:b]
                v -= np.maximum.reduce(v, axis=0)
            np.less(before, lost, out=moved[:, low : at[last]])
            for k in range(n - 1, -1, -1):  # the first language of the highest
                origin[low : at[last]][before[k] == 0] = k
            first = last
        state = best.argmax(0)
        labels = np.empty(start[-1], np.int16)
        places = np.arange(start[-1])
        for t in range(steps - 1, -1, -1):
            a, b = at[t], at[t + 1]
            s = state[: b - a]
            labels[a:b] = s
            state[: b - a] = np.where(moved[s, places[a:b]], origin[a:b], s)
        out: list[np.ndarray] = [np.empty(0, np.int16)] * len(rows)
        for r, i in enumerate(order):
            out[i] = labels[start[: len(rows[i])] + r]
        return out

    def predict(self, texts: list[str | None]) -> list[dict]:
        none = {"lang": UNDETERMINED, "score": 0.0, "spans": []}
        rows: list[np.ndarray] = []
        if len(self.memo) * max(1, len(self.langs)) > 4_000_000:
            self._forget()
        words, ends = [], []
        for k, text in enumerate(texts, 1):
            own = _words(text.lower()) if text and self.langs else []
            if any(map(str.isalpha, own)):
                words += own
            ends.append(len(words))
            if len(words) >= WORDS or k == len(texts):  # the words of some texts are looked up and learned together
                rows += np.split(self.score_rows(words), ends[:-1])
                words, ends = [], []
        out = []
        for text, own, labels in zip(texts, rows, self.label(rows), strict=True):
            if not len(labels):
                out.append(none)
                continue
            size = self.sizes[own]
            share = np.bincount(labels, weights=size, minlength=len(self.langs)) / size.sum()
            out.append({"lang": self.langs[share.argmax()], "score": float(share.max()), "spans": self._spans(text, labels)})
        return out

    def _spans(self, text: str, labels: np.ndarray) -> list[dict]:
        first = np.flatnonzero(np.diff(labels, prepend=-1))
        at = [0]
        if len(first) > 1:
            found = [m.start() for m in re.finditer(r"[^\W\d_]+", text)]
            if len(found) != len(labels):  # lower case may split or join words of rare letters
                found = [m.start() for m in re.finditer(r"[^\W\d_]+", "".join(c if len(c.lower()) > 1 else c.lower() for c in text))]
            at += [found[min(i, len(found) - 1)] for i in first[1:]]
        return [{"start": s, "end": e, "lang": self.langs[labels[i]]} for s, e, i in zip(at, [*at[1:], len(text)], first, strict=True)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letter sequences and scripts of the texts, counted by language: one row for each in a task."""
    found: Counter = Counter()
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        words: dict[str, Counter] = {}
        for lang, text in zip(langs, (t for p in slices(batch.column("text")) for t in p.to_pylist()), strict=True):
            words.setdefault(lang, Counter()).update(_words(text.lower()))
        for lang, counted in words.items():
            for word, n in counted.items():
                found[lang, "script", script_of(word[0])] += n * len(word)
                for g in _grams(word):
                    found[lang, str(len(g)), g] += n
    keys = list(found)
    columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], names=["lang", "kind", "value", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", training_docs: int = TRAINING_DOCS) -> Model:
    """Learn from labelled rows: about ``training_docs`` of each language, chosen by the hash of ``key``."""
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")).filter(
        "text is not null and lang is not null"
    )
    sizes = labelled.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return Model([])
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, training_docs / r["count"])))])
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / (1 << 20)
    sample = labelled.filter(draw < share[F.col("lang")]).select("lang", "text")
    found = sample.mapInArrow(_counts, "lang string, kind string, value string, n bigint").groupBy("lang", "kind", "value").agg(F.sum("n").alias("n"))
    found = materialize(found, "letters")  # read twice
    totals = {(r["lang"], r["kind"]): r["n"] for r in found.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*[x for (g, k), n in totals.items() for x in (F.lit(f"{g}\0{k}"), F.lit(n * LEAST_SHARE))]) if totals else None
    if least is None:
        return Model([])
    kept = found.filter((F.col("n") >= least[F.concat_ws("\0", "lang", "kind")]) | (F.col("kind") == "script"))
    return Model([tuple(r) for r in kept.collect()])


def identify(text: Column | str, model: Model) -> Column:
    """STRUCT<lang, score, spans> of a text."""
    sent = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def language_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
        for batch in batches:
            parts = [pa.array(sent.value.predict(piece.to_pylist()), kind) for piece in slices(batch, 2048)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return language_of(text)


def _held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: those with an id and not held out."""
    return docs.filter(F.col("doc_id").isNotNull() & ~_held_out())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", identify("text", fit(training_rows(docs))).alias("found"))
    return found.select(
        "doc_id", _held_out().alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"),
        F.size("found.spans").cast("long").alias("n_spans"),
    )
