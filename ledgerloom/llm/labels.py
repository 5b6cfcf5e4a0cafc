"""Free-entered labels to the entries of a reference list: a trie searched with Levenshtein automata.

An entry is its words without prepositions; its last word is the *object*, the
words before it the *kind* (``Erlöse aus Umzügen``: erlose, umzug), and an entry
of one word (``Berlin``) is an object alone.  The trie of entries is kept with
its shared parts once: a trie of kinds whose ends lead to the trie of objects
(entries as written), the trie of objects whose ends lead to that of kinds (the
alias path of rearranged labels and compounds), and the trie of objects alone.
A further alias edge leads from the dot of a shortened word to every word end
below its node.  Kinds that head labels of one code are one class (synonyms),
and inflected forms of an object are one object.

A label is folded (case, umlauts however written, letters a scanner confuses
with digits, soft and line-break hyphens, decorations such as enumerators,
footnote marks and remarks; a word the list itself uses is no decoration), and
drives the automaton: per trie node one bit mask of label positions for every
number of errors, cut off beyond a distance that depends on the length of the
word path.  ``entries_within`` returns all entries within the distance;
``match_labels`` takes the nearest code, and a tie between two codes is no match.

Labels are made distinct first, so each is searched once however often it is
typed; a label with more than a 20,000th of all rows meets its code by broadcast.

The list's size is checked before it is broadcast: up to 200,000 entries.

Defined results: null and blank labels are no cases; a label whose letters are
used up by decoration, or that no entry takes, is ``UNMATCHED``; null or blank
entries and entries without a code are not part of the list.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.session import Scratch

UNMATCHED = "UNMATCHED"
MOST_ENTRIES = 200_000
REMEMBERED = 100_000
SHORTEST_STEM = 3
HOT_ROWS, HOT_SHARE = 100_000, 20_000
# Prepositions between kind and object, and decoration words around a label.
PREPOSITIONS = {"an", "von", "aus", "mit", "fur", "f", "gegenuber", "ggu", "bei", "vom", "zu", "der", "den", "dem", "v", "b", "m", "gg", "of", "for", "at", "the", "to", "de", "du"}
DECORATION = {
    "nr", "pos", "position", "lt", "laut", "gem", "anlage", "anl", "anhang", "vj", "vorjahr", "vorj", "gesamt", "ges", "summe", "sum", "insgesamt", "alt", "neu", "siehe", "s", "vgl", "tz", "ziff", "ziffer", "abs",
    "konto", "kto", "teur", "eur", "euro", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "a", "b", "c", "d", "e", "f", "g", "h", "davon", "netto", "brutto", "inkl", "ca", "per", "stand", "ubrige",
}
# Longer words of the two lists above that may be misspelt without meaning anything else.
ASIDE = ("gegenuber", "anlage", "anhang", "gesamt", "insgesamt", "netto", "brutto", "vorjahr", "position", "davon")
_FOLD = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "0": "o", "1": "l", "|": "l", "!": "l", "5": "s", "$": "s"})


LEAST_LENGTH = (0, 3, 6, 11, 18)
MOST_ERRORS = len(LEAST_LENGTH) - 1


def distance_for(length: int) -> int:
    """Errors a word path of so many letters may hold."""
    return sum(length >= x for x in LEAST_LENGTH[1:])


def fold(text: str, digraphs: bool = True) -> str:
    """Lower case, umlauts and (with ``digraphs``) their two-letter spellings to the plain vowel."""
    t = unicodedata.normalize("NFKC", text).lower().replace("ß", "ss")
    if digraphs:
        t = t.replace("ae", "a").replace("oe", "o").replace("ue", "u")
    return "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))


ENUMERATOR = re.compile(r"^\s*(?:\(?[a-z]\)|[ivxlc]+[.)]|(?:nr|pos)?\.?\s*\d+(?:\.\d+)*\s*[a-z]?[.):])\s*", re.IGNORECASE)


def letters(text: str, digraphs: bool = True) -> list[tuple[str, str]]:
    """Folded words with '.' if a dot shortens them, '.-' if the shortened word goes on after a hyphen."""
    t = text.replace("\u00ad", "").replace("\u200b", "")
    t = re.sub(r"(?<=\w)[-‐‑]\s+(?=\w)", "", t)
    t = re.sub(r"\((?:vj|vorjahr|i\. ?vj)[^)]*\)", " ", t, flags=re.I)
    t = re.sub(r"^\s*(?:(?:nr|pos)\.?\s*)?\d+(?:\.\d+)*\s*[.):]\s*|^\s*(?:nr|pos)\.?\s*\d+\s*[.:)]?\s*", "", t, flags=re.I)
    t = re.sub(r"(?<!\w)\d+\)|(?<!\w)\d+(?!\w)|[²³¹⁴]", " ", t)
    t = fold(t, digraphs)
    t = re.sub(r"(?<=[a-z])[01|!5$]+(?=[a-z]|$|\W)|(?<!\w)[01|!5$](?=[a-z]{2})", lambda m: m[0].translate(_FOLD), t)
    return re.findall(r"([a-z]+)((?:\.-?)?)", t)


class Reader:
    """What is left of a label without decoration and prepositions, slightly misspelt long ones included.

    A decoration word that the list uses itself is kept, and so are all words of an entry that had none left.
    """

    def __init__(self, entries: Iterable[str] = ()):
        self.kept: set[str] = set()
        for entry in entries:
            words = [w for w, _ in letters(ENUMERATOR.sub("", entry))]
            self.kept |= {w for w in words if w in DECORATION and len(w) > 1}
            if not any(w not in PREPOSITIONS and w not in DECORATION and len(w) > 1 for w in words):
                self.kept |= set(words)
        self.aside = Trie([((w,), 0) for w in ASIDE if w not in self.kept])
        self.seen: dict[str, bool] = {}

    def dropped(self, word: str) -> bool:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            got = word in PREPOSITIONS or word in DECORATION or len(word) == 1 or (len(word) > 3 and (0, len(word)) in self.aside.search(word, 0, frozenset(), 1 + (len(word) > 7)))
            self.seen[word] = got = got and word not in self.kept
        return got

    def words(self, text: str, digraphs: bool = True) -> list[tuple[str, str]]:
        return [(w, dot) for w, dot in letters(text, digraphs) if not self.dropped(w)]


class Trie:
    """Phrases below one root. A phrase is its words run together; nodes remember where words end."""

    def __init__(self, phrases: Iterable[tuple[tuple[str, ...], int]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[set[int]] = [set()]
        self.depth = [0]
        self.inner = [False]
        self.stem = [0]
        for words, ident in phrases:
            at = 0
            for word in words:
                for i, c in enumerate(word):
                    if c not in self.children[at]:
                        self.children[at][c] = len(self.children)
                        self.children.append({})
                        self.ends.append(set())
                        self.depth.append(self.depth[at] + 1)
                        self.inner.append(False)
                        self.stem.append(0)
                    at = self.children[at][c]
                    self.stem[at] = max(self.stem[at], i + 1)
                self.inner[at] = True
            self.ends[at].add(ident)
        # Errors any phrase below a node may hold, and the next word ends below it.
        self.most = [0] * len(self.children)
        self.next_ends: list[list[int]] = [[] for _ in self.children]
        for at in range(len(self.children) - 1, -1, -1):
            self.most[at] = max([distance_for(self.depth[at]) if self.ends[at] else 0, *(self.most[x] for x in self.children[at].values())])
            for x in self.children[at].values():
                self.next_ends[at] += [x] if self.inner[x] else self.next_ends[x]

    def within_word(self, at: int) -> Iterator[int]:
        """Nodes below ``at`` up to and without the next word ends."""
        for x in self.children[at].values():
            if not self.inner[x]:
                yield x
                yield from self.within_word(x)

    def search(self, text: str, start: int, dots: frozenset[int], most: int) -> dict[tuple[int, int], int]:
        """(id, end position) -> least errors of every phrase that reads from ``start``, within its distance.

        A state is one mask per number of errors: bit i says that i characters of the text are read with that many errors at most.
        """
        found: dict[tuple[int, int], int] = {}
        n = len(text) - start
        most = min(most, MOST_ERRORS)
        full = (1 << (n + 1)) - 1
        at_char: dict[str, int] = {}
        for i in range(n):
            at_char[text[start + i]] = at_char.get(text[start + i], 0) | 1 << i
        dot = goes_on = 0
        for p in dots:
            if p - start >= SHORTEST_STEM:
                dot |= 1 << (p - start)
            if p < 0 and -p - start >= 0 and -p < len(text):
                goes_on |= 1 << (-p - start)

        def note(node: int, state: list[int], depth: int) -> None:
            seen = 0
            for d, bits in enumerate(state):
                fresh = bits & ~seen
                seen |= bits
                if d:
                    if depth < LEAST_LENGTH[d]:
                        break
                    fresh = fresh >> LEAST_LENGTH[d] << LEAST_LENGTH[d]
                while fresh:
                    low = fresh & -fresh
                    fresh ^= low
                    p = start + low.bit_length() - 1
                    for ident in self.ends[node]:
                        if d < found.get((ident, p), 99):
                            found[(ident, p)] = d

        stack = [(0, [((1 << (d + 1)) - 1) & full for d in range(most + 1)], None, 0)]
        while stack:
            at, states, before, last = stack.pop()
            if self.ends[at]:
                note(at, states, self.depth[at])
            if dot and self.stem[at] >= SHORTEST_STEM and states[-1] & dot:
                cut, under = [], 0
                for d, bits in enumerate(states):
                    under |= (bits & dot) >> LEAST_LENGTH[d] << LEAST_LENGTH[d]
                    cut.append(under)
                if under:
                    for end in self.next_ends[at]:
                        if self.ends[end]:
                            note(end, cut, 99)
                        if self.children[end]:
                            stack.append((end, cut, None, 0))
                    # A shortened first part of a compound: its last part goes on somewhere below in the same word.
                    if under & goes_on:
                        for x in self.within_word(at):
                            follow = 0
                            for c in self.children[x]:
                                follow |= at_char.get(c, 0)
                            if under & goes_on & follow:
                                stack.append((x, [bits & goes_on & follow for bits in cut], None, 0))
            for c, child in self.children[at].items():
                limit = min(most, self.most[child])
                here = at_char.get(c, 0)
                new = [(states[0] & here) << 1]
                # Two neighbouring letters that changed places are one error.
                swap = here & (last >> 1) if before is not None else 0
                for d in range(1, limit + 1):
                    less = states[d - 1]
                    bits = ((states[d] & here) << 1) | less | (less << 1) | (new[d - 1] << 1)
                    if swap:
                        bits |= (before[d - 1] & swap) << 2
                    new.append(bits & full)
                if new[-1]:
                    stack.append((child, new, states, here))
        return found


class Reference:
    """The list as tries of kinds and objects, and the codes and entries of every pair of them."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.reader = Reader(label for label, _ in rows)
        glued: set[tuple[tuple[str, ...], str]] = set()
        parsed = []
        for label, code in rows:
            words = [w for w, _ in self.reader.words(label)]
            if not words:
                continue
            kind, thing = tuple(words[:-1]), words[-1]
            parsed.append((kind, thing, code, label))
            # A preposition run together with the kind is one more alias path.
            glued |= {(kind, p) for p in re.findall(r"[a-z]+", fold(label)) if p in PREPOSITIONS and len(p) > 1}
        # Kinds that head labels of one code are one class; the objects that stand alone are a class of their own.
        kinds = sorted({k for k, *_ in parsed})
        root = {k: k for k in kinds}

        def find(k: tuple[str, ...]) -> tuple[str, ...]:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        by_code: dict[str, tuple[str, ...]] = {}
        for kind, _, code, _ in parsed:
            if kind:
                a, b = find(kind), find(by_code.setdefault(code, kind))
                root[max(a, b)] = min(a, b)
        # Inflected forms of one object: equal up to a final n or en.
        stem = lambda w: w[:-2] if w.endswith("en") and len(w) > 5 else w[:-1] if w[-1:] in "en" and len(w) > 5 else w
        stem_id = {x: i for i, x in enumerate(sorted({stem(t) for _, t, *_ in parsed}))}
        kind_id = {k: i for i, k in enumerate(kinds)}
        self.class_of = {kind_id[k]: kind_id[find(k)] for k in kinds}
        self.alone = kind_id.get(())
        self.kinds = Trie(sorted({(k, kind_id[k]) for k in kinds if k} | {((*k, p), kind_id[k]) for k, p in glued if k}))
        self.things = Trie(sorted({((t,), stem_id[stem(t)]) for _, t, *_ in parsed}))
        self.codes: dict[tuple[int, int], set[str]] = defaultdict(set)
        self.entries: dict[tuple[int, int], set[tuple[str, str]]] = defaultdict(set)
        for kind, thing, code, label in parsed:
            self.codes[(self.class_of[kind_id[kind]], stem_id[stem(thing)])].add(code)
            self.entries[(kind_id[kind], stem_id[stem(thing)])].add((label, code))
        self.tails: dict[tuple[bool, str, frozenset[int], int], dict[int, int]] = {}

    def _rest(self, kind_first: bool, text: str, dots: frozenset[int], most: int) -> dict[int, int]:
        """Id -> least errors of what reads the whole ``text`` as the second part; remembered, as objects repeat."""
        key = (kind_first, text, dots, most)
        got = self.tails.get(key)
        if got is None:
            if len(self.tails) > REMEMBERED:
                self.tails.clear()
            trie = self.things if kind_first else self.kinds
            got = {ident: e for (ident, end), e in trie.search(text, 0, dots, most).items() if end == len(text)}
            self.tails[key] = got
        return got

    def _pairs(self, label: str, digraphs: bool = True, most: int = MOST_ERRORS) -> dict[tuple[int, int], int]:
        """(kind, object) -> least total errors of every path of the trie that reads the whole label with at most ``most`` in either part."""
        text, dots = "", set()
        for word, dot in self.reader.words(label, digraphs):
            text += word
            if dot:
                dots.add(len(text))
            if dot == ".-":
                dots.add(-len(text))
        if not text:
            return {}
        marks, n, out = frozenset(dots), len(text), {}
        if self.alone is not None:
            out = {(self.alone, thing): e for thing, e in self._rest(True, text, marks, most).items()}
        for kind_first in (True, False):
            trie = self.kinds if kind_first else self.things
            for (ident, at), d in trie.search(text, 0, marks, most).items():
                if at >= n:
                    continue
                tail = frozenset([*(x - at for x in marks if x > at), *(x + at for x in marks if -x > at)]) if marks else marks
                for other, e in self._rest(kind_first, text[at:], tail, most).items():
                    pair = (ident, other) if kind_first else (other, ident)
                    if d + e < out.get(pair, 99):
                        out[pair] = d + e
        return out

    def entries_within(self, label: str) -> list[tuple[str, str, int]]:
        """(entry, code, errors) of all entries within their distances, nearest first."""
        near = [(entry, code, e) for pair, e in self._pairs(label).items() for entry, code in self.entries.get(pair, ())]
        return sorted(near, key=lambda x: (x[2], x[0], x[1]))

    def _codes(self, label: str, digraphs: bool = True) -> dict[str, int]:
        """Code -> least errors of the nearest codes; '' stands for pairs of a kind and an object that the list does not have.

        The automaton is run with none and with one error first: whatever reads the label with k errors in all has at most k
        in either part, and most labels need no more; for the others the full distance is cheaper than a level each.
        """
        out: dict[str, int] = {}
        for most in (0, 1, MOST_ERRORS):
            for (kind, thing), e in self._pairs(label, digraphs, most).items():
                for code in self.codes.get((self.class_of[kind], thing), ("",)):
                    if (code or kind != self.alone) and e < out.get(code, 99):
                        out[code] = e
            if out and min(out.values()) <= most:
                break
        return out

    def code_of(self, label: str) -> str:
        """The nearest code; UNMATCHED where a pair the list does not have is nearer, or two codes tie."""
        near = self._codes(label)
        if not near and re.search("[aou]e", label, re.IGNORECASE):
            # Two letters taken for an umlaut may be what a misspelling left side by side.
            near = self._codes(label, digraphs=False)
        if not near:
            return UNMATCHED
        least = min(near.values())
        best = [c for c, d in near.items() if d == least]
        return best[0] if len(best) == 1 and best[0] else UNMATCHED


@functools.lru_cache(maxsize=4)
def _reference(rows: tuple[tuple[str, str], ...]) -> Reference:
    return Reference(list(rows))


def _shared(reference: DataFrame, entry: str, code: str) -> Broadcast:
    """The list as a broadcast value, if it has at most ``MOST_ENTRIES`` entries."""
    rows = reference.select(entry, code).where(F.col(entry).rlike(r"[^\s\p{Z}]") & F.col(code).isNotNull()).distinct().limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the reference list has more than {MOST_ENTRIES} entries; a broadcast trie is not meant for that")
    return reference.sparkSession.sparkContext.broadcast(tuple(sorted((r[0], r[1]) for r in rows)))


def _distinct(aliases: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """The cases (key, label), and every distinct label with its number of rows."""
    cases = aliases.select(F.col(key).alias("key"), F.col(label).alias("label")).where(F.col("label").rlike(r"[^\s\p{Z}]"))
    return cases, cases.groupBy("label").agg(F.count("*").alias("n"))


def match_labels(aliases: DataFrame, reference: DataFrame, key: str, label: str, entry: str, code: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``key``, ``code`` for every row of ``aliases`` with a label that is neither null nor blank."""
    shared = _shared(reference, entry, code)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _reference(shared.value)
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "code": [known.code_of(t) for t in b["label"]], "n": b["n"]})

    cases, labels = _distinct(aliases, key, label)
    watch = Observation()
    found = labels.repartition(2 * aliases.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "label string, code string, n long").observe(watch, F.max("n").alias("most"), F.sum("n").alias("rows"))
    found = Scratch(aliases.sparkSession, "labels").write(found, "found")
    hot = max(hot_rows, (watch.get["rows"] or 0) // HOT_SHARE)
    if (watch.get["most"] or 0) <= hot:
        out = cases.join(found, "label")
    else:
        top = F.broadcast(found.where(F.col("n") > hot))
        out = cases.join(top, "label", "left_anti").join(found, "label").unionByName(cases.join(top, "label"))
    return out.select(F.col("key").alias(key), F.col("code").alias(code))


def entries_within(aliases: DataFrame, reference: DataFrame, key: str, label: str, entry: str, code: str) -> DataFrame:
    """``key``, ``entry``, ``code``, distance: all entries within the length-dependent distance of each label, for review."""
    shared = _shared(reference, entry, code)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _reference(shared.value)
        for b in batches:
            rows = [(t, *e) for t in b["label"] for e in known.entries_within(t)]
            yield pd.DataFrame(rows, columns=["label", "entry", "code", "distance"])

    cases, labels = _distinct(aliases, key, label)
    near = labels.repartition(2 * aliases.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "label string, entry string, code string, distance int")
    return cases.join(near, "label").select(F.col("key").alias(key), F.col("entry").alias(entry), F.col("code").alias(code), "distance")
