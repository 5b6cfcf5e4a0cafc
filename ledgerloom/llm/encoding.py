"""Text decoded with a wrong encoding: found by character n-gram models, and given back as it was.

A candidate chain undoes one or two wrong decodings: the text is encoded again
with the encoding it was read in, and decoded with the one it was written in.
Chains work word by word and character run by character run, so a cell that is
garbled in part is repaired in part and its correct words stay.

The model is an interpolated character trigram model with words as units
(digits count as one character).  It is trained in two passes over all words
of all cells and headings: the second pass leaves out what the first finds
garbled, so that the final model knows clean text only, names in other scripts
included.  Every candidate of a word is scored by the log-likelihood it gains
over the word as it stands.  The margin a gain must exceed is validated on
words the model knows as clean: as they are (nothing may be accepted), and
garbled through every chain (the original must come back).

A replacement character stands for a byte that is gone; a text holding one is
affected and not restorable: it comes out as ''.

Nothing is cut: all n-grams of all words are counted and all of them score, and
the margin is fitted on all clean words.  A model of up to ``MOST_GRAMS`` n-grams
is broadcast.  A larger one stays a table: distinct words are dealt into groups,
and every group is given the counts that its words and their candidates need, so
both ways score alike.

Defined results: null and empty cells are skipped; plain ASCII text is never
touched; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.skew import join_unique
from ledgerloom.session import Scratch

#: N-grams of a model that is broadcast; gains sorted at once; rows a Python worker gathers before it hands them on.
MOST_GRAMS, MOST_GAINS, GATHERED = 400_000, 100_000, 500_000
#: Words of a task or group: scored as they are, and through all chains.
WORDS_SCORED, WORDS_GARBLED = 2_000, 100
FOREIGN = r"[\x{80}-\x{10FFFF}]"
FIRST_MARGIN = 2.0
SMOOTHING = 2.0
LOST = "�"
REMEMBERED = 200_000
# Encodings texts are mistaken for, and the ones they were written in.
READ_AS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859_15", "cp852")
WRITTEN_IN = ("cp1252", "mac_roman", "cp437", "cp850")


@functools.cache
def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte; bytes an encoding leaves undefined stand for the control character of that number."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if encoding == "cp1252":
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


@functools.cache
def _chars_of(encoding: str) -> dict[int, str]:
    return {b: c for c, b in _bytes_of(encoding).items() if not 128 <= ord(c) < 160}


def _utf8(text: str, read_as: str) -> str:
    """Every run of characters that is UTF-8 when encoded in ``read_as`` again, decoded; the rest as it is."""
    of = _bytes_of(read_as)
    out, i, n = [], 0, len(text)
    while i < n:
        lead = of.get(text[i], 0)
        length = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        if length and i + length <= n:
            raw = [of.get(c, 0) for c in text[i : i + length]]
            try:
                c = bytes(raw).decode("utf-8")
                if not 128 <= ord(c) < 160 or read_as == "cp1252":
                    out.append(c)
                    i += length
                    continue
            except UnicodeDecodeError:
                pass
        out.append(text[i])
        i += 1
    return "".join(out)


def _single(text: str, read_as: str, written_in: str) -> str:
    of, to = _bytes_of(read_as), _chars_of(written_in)
    return "".join(c if c < "\x80" else to.get(of.get(c, -1), c) for c in text)


def _chains() -> list[tuple[str, Callable[[str], str], Callable[[str], str | None]]]:
    """name, repair, and the garbling it undoes (None where that is impossible)."""

    def wrong(text: str, written_in: str, read_as: str) -> str | None:
        try:
            raw = text.encode(written_in)
        except UnicodeEncodeError:
            return None
        of = {b: c for c, b in _bytes_of(read_as).items()}
        return "".join(of[b] for b in raw)

    out = []
    for r in READ_AS:
        out.append((f"utf-8 as {r}", lambda t, r=r: _utf8(t, r), lambda t, r=r: wrong(t, "utf-8", r)))
        out.append((f"utf-8 as {r}, utf-8 as cp1252", lambda t, r=r: _utf8(_utf8(t, "cp1252"), r), lambda t, r=r: (x := wrong(t, "utf-8", r)) and wrong(x, "utf-8", "cp1252")))
        for w in WRITTEN_IN:
            if w != r:
                out.append((f"{w} as {r}", lambda t, r=r, w=w: _single(t, r, w), lambda t, r=r, w=w: wrong(t, w, r)))
    return out


CHAINS = _chains()


def _plain(word: str) -> str:
    return " " + "".join("0" if "0" <= c <= "9" else c for c in word) + " "


@functools.cache
def _floor(c: str) -> float:
    """What an unseen character is worth: a letter may belong to a name not met yet, a symbol hardly, a control never."""
    kind = unicodedata.category(c)[0]
    return 1e-6 if kind == "L" else 1e-9 if kind == "C" else 1e-8


class Model:
    """Interpolated character trigrams over words."""

    def __init__(self, grams: dict[str, float], total: float):
        """``grams``: counts, at least of all n-grams of the texts to score; ``total``: characters of the whole corpus."""
        self.g, self.total = grams, total

    def score(self, word: str) -> float:
        g, k, out = self.g, SMOOTHING, 0.0
        t = _plain(word)
        for i in range(1, len(t)):
            c, b, ab = t[i], t[i - 1 : i], t[max(0, i - 2) : i]
            p = g.get(c, 0.0) / self.total + _floor(c)
            p = (g.get(b + c, 0.0) + k * p) / (g.get(b, 0.0) + k)
            if len(ab) == 2:
                p = (g.get(ab + c, 0.0) + k * p) / (g.get(ab, 0.0) + k)
            out += math.log(p)
        return out

    def best(self, word: str) -> tuple[str, float]:
        """The likeliest other reading of a word and what it gains; ('', -inf) if no chain changes the word."""
        now, best, gain = self.score(word), "", -math.inf
        for text in {repair(word) for _, repair, _ in CHAINS} - {word}:
            if (d := self.score(text) - now) > gain or (d == gain and text < best):
                best, gain = text, d
        return best, gain


def grams_of(word: str) -> list[str]:
    t = _plain(word)
    return [*t, *(t[i : i + 2] for i in range(len(t) - 1)), *(t[i : i + 3] for i in range(len(t) - 2))]


def candidates(word: str) -> set[str]:
    """All texts that ``Model.best`` scores for a word."""
    return {word, *(repair(word) for _, repair, _ in CHAINS)}


def garbled(word: str) -> set[str]:
    """The word garbled through every chain that changes it."""
    return {bad for _, _, garble in CHAINS if (bad := garble(word)) and bad != word}


class Counts:
    """A model as the table (gram, n) of its counts, held whole and broadcast where they are few."""

    def __init__(self, grams: DataFrame):
        n, total = grams.agg(F.count("*"), F.sum(F.when(F.length("gram") == 1, F.col("n")))).first()
        self.grams, self.total = grams, float(total or 1)
        self.whole = self._model(grams) if n <= MOST_GRAMS else None
        self.shared = grams.sparkSession.sparkContext.broadcast(self.whole) if self.whole else None

    def _model(self, grams: DataFrame) -> Model:
        return Model({gram: float(n) for gram, n in grams.collect()}, self.total)

    def best(self, word: str) -> tuple[str, float]:
        """``Model.best`` of one word, for which a model that is not held whole is searched."""
        model = self.whole or self._model(self.grams.where(F.col("gram").isin(sorted({g for t in candidates(word) for g in grams_of(t)}))))
        return model.best(word)

    def over(self, words: DataFrame, texts: Callable[[str], set[str]], run: Callable[[pd.DataFrame, Model], pd.DataFrame], schema: str, at_once: int) -> DataFrame:
        """``run`` over all ``words`` (word is unique), ``at_once`` or so in a task or group; ``texts`` are all that it scores for a word."""
        groups, total, shared = max(1, -(-words.count() // at_once)), self.total, self.shared
        if shared is not None:

            def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    yield run(b, shared.value)

            return (words.repartition(groups, "word") if groups > 1 else words).mapInPandas(whole, schema)

        # Of a gram with a character that the corpus lacks there is no count.
        letters = self.grams.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in self.grams.where(F.length("gram") == 1).select("gram").collect()))

        def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: set[tuple[int, str]] = set()
            for b in batches:
                for group, word in zip(b["group"], b["word"], strict=True):
                    seen.update((group, gram) for gram in {g for t in texts(word) for g in grams_of(t)} if letters.value.issuperset(gram))
                    if len(seen) > GATHERED:
                        yield pd.DataFrame(list(seen), columns=["group", "gram"])
                        seen.clear()
            if seen:
                yield pd.DataFrame(list(seen), columns=["group", "gram"])

        grouped = words.withColumn("group", F.pmod(F.xxhash64("word"), F.lit(groups)))
        wanted = grouped.select("group", "word").repartition("group").sortWithinPartitions("group").mapInPandas(needed, "group long, gram string").distinct()
        known = wanted.join(self.grams, "gram").select("group", "gram", "n")

        def part(b: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
            return run(b, Model(dict(zip(counts["gram"], counts["n"].astype(float), strict=True)), total))

        return grouped.groupBy("group").cogroup(known.groupBy("group")).applyInPandas(part, schema)


def _train(words: DataFrame) -> DataFrame:
    """Counts of all character 1- to 3-grams of ``words`` (word, n), without words that hold a run of
    UTF-8 read as something else (a rare word would vouch for itself)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for word, n in zip(batch["word"], batch["n"], strict=True):
                if not word.isascii() and (LOST in word or any(_utf8(word, r) != word for r in READ_AS)):
                    continue
                for gram, m in Counter(grams_of(word)).items():
                    seen[gram] += m * int(n)
            if len(seen) > GATHERED:
                yield pd.DataFrame({"gram": list(seen.keys()), "n": list(seen.values())})
                seen.clear()
        if seen:
            yield pd.DataFrame({"gram": list(seen.keys()), "n": list(seen.values())})

    return words.mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _clean(words: pd.DataFrame, model: Model) -> pd.DataFrame:
    """The words that a first model does not find garbled."""
    return words.loc[[model.best(w)[1] <= FIRST_MARGIN for w in words["word"]], ["word", "n"]]


def _gains(words: pd.DataFrame, model: Model) -> pd.DataFrame:
    """What clean words gain by being changed (not restored), and garbled ones by being restored, once for every chain."""
    rows = []
    for w in words["word"]:
        gain = model.best(w)[1]
        if gain > -math.inf:
            rows.append((False, gain))
        back = {bad: model.best(bad) for bad in garbled(w)}
        rows += [(True, back[bad][1]) for _, _, garble in CHAINS if (bad := garble(w)) in back and back[bad][0] == w]
    return pd.DataFrame(rows, columns=["restored", "gain"])


def _smallest(gains: DataFrame, k: int) -> float:
    """The ``k``-th smallest gain, from 0: the range that holds it is narrowed until few are left to sort."""
    while True:
        low, high, n = gains.agg(F.min("gain"), F.max("gain"), F.count("*")).first()
        if low == high or n <= MOST_GAINS:
            return low if low == high else sorted(r[0] for r in gains.select("gain").collect())[k]
        part = F.least(F.floor((F.col("gain") - low) / (high - low) * 1000), F.lit(999))
        for found, m in gains.groupBy(part.alias("part")).count().orderBy("part").collect():  # noqa: B007
            if k < m:
                break
            k -= m
        gains = gains.where(part == found)


def validated_margin(gains: DataFrame) -> float:
    """The margin between what clean words gain by being changed and what garbled ones gain by being restored."""
    found = {r["restored"]: r for r in gains.groupBy("restored").agg(F.count("*").alias("n"), F.max("gain").alias("most")).collect()}
    if True not in found:
        return 4.0
    top = found[False]["most"] if False in found else 0.0
    # Between the largest gain of a clean word and the gain that 99.5 % of the restorable garbled words exceed.
    low = _smallest(gains.where("restored"), found[True]["n"] // 200)
    return max(FIRST_MARGIN, (top + low) / 2 if low > top else top + 0.1)


def cells_of(tables: DataFrame) -> DataFrame:
    """table_id, row_no, col_no, text of every non-empty cell; headings at (-1, -1)."""
    rows = tables.select("table_id", F.posexplode("rows").alias("row_no", "cells")).select("table_id", "row_no", F.posexplode("cells").alias("col_no", "text"))
    heads = tables.select("table_id", F.lit(-1).alias("row_no"), F.lit(-1).alias("col_no"), F.col("heading").alias("text"))
    return rows.unionByName(heads).where("text is not null and text != ''")


def fit(cells: DataFrame, scratch: Scratch) -> tuple[Counts, float]:
    """The clean-text model and its validated margin, from all cells."""
    digits: Column = F.regexp_replace("word", "[0-9]", "0")
    words = cells.select(F.explode(F.split("text", " ")).alias("word")).select(digits.alias("word")).where(F.col("word").rlike(r"[\p{L}\x{80}-\x{10FFFF}]"))
    words = scratch.write(words.groupBy("word").agg(F.count("*").alias("n")), "words")
    foreign = F.col("word").rlike(FOREIGN)
    first = Counts(scratch.write(_train(words), "grams0"))
    clean = scratch.write(first.over(words.where(foreign & ~F.contains("word", F.lit(LOST))), candidates, _clean, "word string, n long", WORDS_SCORED), "clean")
    model = Counts(scratch.write(_train(words.where(~foreign).unionByName(clean)), "grams"))
    tried = lambda w: {t for x in [w, *garbled(w)] for t in candidates(x)}
    gains = scratch.write(model.over(clean, tried, _gains, "restored boolean, gain double", WORDS_GARBLED), "gains")
    return model, validated_margin(gains)


def restored_text(text: str, model: Model | Counts, margin: float, known: dict[str, str]) -> str | None:
    """The whole original text, '' if characters are lost for good, None if nothing is garbled."""
    if LOST in text:
        return ""
    out = []
    for word in text.split(" "):
        if not word.isascii():
            fixed = known.get(word)
            if fixed is None:
                other, gain = model.best(word)
                fixed = other if gain > margin else word
                if len(known) > REMEMBERED:
                    known.clear()
                known[word] = fixed
            word = fixed
        out.append(word)
    whole = " ".join(out)
    return None if whole == text else whole


def _restored_by_word(special: DataFrame, model: Counts, margin: float, scratch: Scratch) -> DataFrame:
    """``restored_text`` of all texts as joins: every distinct word is scored once, its texts are put together, cells find their text."""
    lost = F.contains("text", F.lit(LOST))
    texts = special.where(~lost).select("text").distinct()
    pieces = texts.select("text", F.explode(F.array_distinct(F.split("text", " "))).alias("piece")).where(F.col("piece").rlike(FOREIGN))

    def fix(words: pd.DataFrame, model: Model) -> pd.DataFrame:
        rows = [(w, other) for w in words["word"] for other, gain in [model.best(w)] if gain > margin]
        return pd.DataFrame(rows, columns=["word", "fixed"])

    words = scratch.write(pieces.select(F.col("piece").alias("word")).distinct(), "pieces")
    fixes = scratch.write(model.over(words, candidates, fix, "word string, fixed string", WORDS_SCORED), "fixes")
    known = join_unique(pieces, "piece", fixes, "word").where("fixed is not null").groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("piece", "fixed"))).alias("known"))
    whole = F.array_join(F.transform(F.split("text", " "), lambda w: F.coalesce(F.try_element_at("known", w), w)), " ")
    put = scratch.write(known.select(F.col("text").alias("found"), whole.alias("restored")), "restored")
    gone = special.where(lost).withColumn("restored", F.lit(""))
    return join_unique(special.where(~lost), "text", put, "found").where("restored != text").drop("found").unionByName(gone).drop("text")


def restore(tables: DataFrame) -> DataFrame:
    """table_id, row_no, col_no, restored: one row per affected cell or heading."""
    scratch = Scratch(tables.sparkSession, "encoding")
    cells = cells_of(tables)
    model, margin = fit(cells, scratch)
    special = cells.where(F.col("text").rlike(FOREIGN))
    if model.shared is None:
        return _restored_by_word(special, model, margin, scratch)
    shared = model.shared

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str] = {}
        for b in batches:
            b["restored"] = [restored_text(t, shared.value, margin, known) for t in b["text"]]
            found = b.loc[b["restored"].notna(), ["table_id", "row_no", "col_no", "restored"]]
            if len(found):
                yield found

    kind = dict(tables.dtypes)["table_id"]
    return special.mapInPandas(run, f"table_id {kind}, row_no int, col_no int, restored string")
