"""Scores texts where they are read: a map over batches of texts with the model's tables in every worker, without an exchange.

Scores add up over words, and a word's evidence depends on nothing but the model. So a worker keeps a table with a row for each
distinct piece of text that it has met, a dictionary from piece to row, and adds up the rows of a text's pieces. Table and dictionary
are bounded in bytes; when they are full, they start anew. What a model may weigh to be sent to workers is bounded as well
(Model.fits); larger ones are joined (detect.joined).

Evidence is one array of whole numbers for each text: sums in millionths of a nat and counts, laid out by Layout. It is the same
whichever way it was worked out, merges by adding, and decided() makes a result of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex

from ..functions import catalog
from ..functions.text import APOSTROPHES, LONGEST, LONGEST_CJ

UNKNOWN = catalog.UNKNOWN
#: Bytes of a worker's table of pieces, and of what is added up at once; new pieces that are scored at once; rows of texts that are held at once.
TABLE_BYTES, SLICE_BYTES, FRESH, ROWS = 24 << 20, 8 << 20, 4096, 500
#: Share of kana among Han and kana characters beyond which a text is Japanese, and the floor of an unknown Chinese or Japanese gram.
KANA_SHARE, CJ_FLOOR_U = 0.01, -12_000_000


@dataclass(frozen=True)
class Facts:
    """What scoring and deciding need to know of a model besides its tables."""

    languages: tuple[str, ...]
    alphabets: tuple[str, ...]
    floor_u: int
    tw_floor_u: int
    has_cj: bool

    @property
    def cj(self) -> list[int]:
        return [i for i, x in enumerate(self.languages) if self.has_cj and x in catalog.GROUPS["cj"]]

    def users(self, alphabet: str) -> list[int]:
        return [i for i, x in enumerate(self.languages) if alphabet in catalog.BY_ISO[x].alphabets]

    @property
    def single(self) -> list[int]:
        """For each script its only language, or -1."""
        users = [self.users(a) for a in self.alphabets]
        return [u[0] if len(u) == 1 and not (self.has_cj and a in catalog.CJ_ALPHABETS) else -1 for a, u in zip(self.alphabets, users, strict=True)]


class Layout:
    """Where what stands in an array of evidence. By language: sums and hits of n-grams and of topwords; by script: characters,
    words, topword lookups; with a Chinese and Japanese table, by those languages: sums and hits of single characters and of
    pairs, and how many of both there are."""

    def __init__(self, facts: Facts):
        languages, scripts, cj = len(facts.languages), len(facts.alphabets), len(facts.cj)
        at = 0
        for name, size in [(n, languages) for n in ("ng_u", "ng_hits", "tw_u", "tw_hits")] + [(n, scripts) for n in ("chars", "words", "lookups")] + [(n, cj) for n in ("uni_u", "uni_hits", "bi_u", "bi_hits")] + [("grams", 2 if cj else 0)]:
            setattr(self, name, slice(at, at + size))
            at += size
        self.width = at


@cache
def ranges(script: str) -> str:
    """The letters of a Unicode script, as ranges inside of a character class."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    runs = [m[0] for m in regex.finditer(rf"\p{{Script={script}}}+", every)]
    return "".join(re.escape(r[0]) + ("-" + re.escape(r[-1]) if len(r) > 1 else "") for r in runs)


def letters(alphabet: str) -> str:
    return "".join(map(ranges, catalog.ALPHABETS[alphabet][1]))


def piece_pattern(alphabets, d: str = "0-9") -> str:
    """A run of letters of one script, with digits (d inside of a character class) anywhere and single apostrophes after a letter or digit."""
    q = f"[{APOSTROPHES}]"
    return "|".join(f"(?:(?<![{d}])[{d}]++)?+[{c}][{c}{d}]*+(?:{q}[{d}]*[{c}][{c}{d}]*+)*+(?:{q}[{d}]*+)?" for c in map(letters, alphabets))


class Tiles:
    """The n-grams of many words at once. An n-gram is a whole number: its letters' numbers, from 1 on, side by side; 0 is a letter that
    no n-gram has. So numbers are equal if n-grams are, and no n-gram is taken for another one."""

    def __init__(self, grams: dict, params):
        self.params = params
        known = sorted({c for g in grams for c in g})
        self.bits = len(known).bit_length()
        self.fits = self.bits * params.max_ngram < 64
        if not self.fits:
            return
        self.number = np.zeros(0x110000, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        self.number[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.tables = {}  # n -> numbers in order; from where to where their evidence stands, languages, logarithms
        for n in range(params.min_ngram, params.max_ngram + 1):
            own = [g for g in grams if len(g) == n]
            keys = self.keys(self.codes(own), n)[::n] if own else np.zeros(0, dtype=np.int64)
            order = np.argsort(keys)
            evidence = [grams[own[i]] for i in order.tolist()]
            ends = np.cumsum([0, *map(len, evidence)])
            self.tables[n] = (keys[order], ends, np.array([x for e in evidence for x, _ in e], dtype=np.int64), np.array([u for e in evidence for _, u in e], dtype=np.int64))

    def codes(self, words: list[str]) -> np.ndarray:
        return self.number[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)].astype(np.int64)

    def keys(self, codes: np.ndarray, n: int) -> np.ndarray:
        """The n-gram that begins at each letter; at the last ones it is none."""
        out = np.zeros(len(codes), dtype=np.int64)
        size = max(0, len(codes) - n + 1)
        for i in range(n):
            out[:size] = out[:size] << self.bits | codes[i : i + size]
        return out

    def add(self, block: np.ndarray, words: list[str], of: list[int], at: Layout) -> None:
        """What the n-grams of words say, added to rows `of` of a block."""
        languages = at.ng_u.stop - at.ng_u.start
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        word, codes = np.repeat(np.arange(len(words)), sizes), self.codes(words)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
        open_ = np.ones(len(words), dtype=bool)
        cells, us = [], []
        for n in range(self.params.max_ngram, self.params.min_ngram - 1, -1):
            keys, ends, langs, u = self.tables[n]
            here = np.flatnonzero((left >= n) & open_[word])
            asked, mine = self.keys(codes, n)[here], word[here]
            if len(keys):
                i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                hit = keys[i] == asked
                begin, count = ends[i[hit]], ends[i[hit] + 1] - ends[i[hit]]
                each = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
                cells.append(np.repeat(mine[hit], count) * languages + langs[each])
                us.append(u[each])
            else:
                hit = np.zeros(len(here), dtype=bool)
            if n <= self.params.stop:  # words of this length or longer of which every n-gram was found are done
                lacks = np.zeros(len(words), dtype=bool)
                lacks[mine[~hit]] = True
                open_ &= lacks | (sizes < n)
        if cells:
            cells, us = np.concatenate(cells), np.concatenate(us)
            shape, of = (len(words), languages), np.array(of)
            sums = np.bincount(cells, weights=us, minlength=len(words) * languages)  # below 2^53, so exact
            np.add.at(block[:, at.ng_u], of, np.rint(sums).astype(np.int64).reshape(shape))
            np.add.at(block[:, at.ng_hits], of, np.bincount(cells, minlength=len(words) * languages).reshape(shape))


class Pieces(dict):
    """piece -> its row in the table, numbered when first met and worked out with other new ones."""

    def __init__(self, facts: Facts, tables: dict, params):
        super().__init__()
        self.facts, self.at, self.params = facts, Layout(facts), params
        self.grams, self.tops, self.skips, self.cj = tables["grams"], tables["tops"] if params.topwords else None, tables["skips"], tables["cj"]
        self.pattern = re.compile(piece_pattern(facts.alphabets))
        only = letters(facts.alphabets[0]) if len(facts.alphabets) == 1 else ""
        self.plain = re.compile(f"[{only}]+") if only else None
        self.odd = re.compile(f"[0-9{APOSTROPHES}]")
        self.scripts = [re.compile(f"[{letters(a)}]") for a in facts.alphabets]
        self.single = facts.single
        self.size = max(1024, TABLE_BYTES // (8 * self.at.width))
        self.slice = max(256, min(self.size // 2, SLICE_BYTES // (8 * self.at.width)))
        self.table = np.zeros((self.size, self.at.width), dtype=np.int64)
        self.tiles, self.fresh = Tiles(self.grams, params), []

    def sums(self, texts: list) -> np.ndarray:
        """The evidence of each text."""
        out = np.zeros((len(texts), self.at.width), dtype=np.int64)
        flat, of, sizes = [], [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            found = (self.plain if self.plain and not self.odd.search(t) else self.pattern).findall(t)
            for lo in range(0, len(found), self.slice):
                part = found[lo : lo + self.slice]
                if len(flat) + len(part) > self.slice:
                    self._add(out, flat, of, sizes)
                    flat, of, sizes = [], [], []
                flat += part
                of.append(i)
                sizes.append(len(part))
        if flat:
            self._add(out, flat, of, sizes)
        return out

    def _add(self, out: np.ndarray, flat: list, of: list, sizes: list) -> None:
        if len(self) + len(flat) > self.size:
            self.clear()
        at = np.fromiter(map(self.__getitem__, flat), dtype=np.int64, count=len(flat))
        self._fill()
        rows = self.table[at]
        np.add.at(out, of, np.add.reduceat(rows, np.cumsum([0, *sizes[:-1]]), axis=0))

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n

    def _fill(self) -> None:
        """The rows of the pieces that were met since the last time."""
        first, several = len(self) - len(self.fresh), len(self.scripts) > 1
        for lo in range(0, len(self.fresh), FRESH):
            part, rows, tiled, of = self.fresh[lo : lo + FRESH], [], [], []
            for i, piece in enumerate(part):
                row = [0] * self.at.width
                script = next(i for i, p in enumerate(self.scripts) if p.search(piece)) if several else 0
                for word in self.words(piece, self.facts.alphabets[script]):
                    if self.score(word, script, row):
                        tiled.append(word)
                        of.append(i)
                rows.append(row)
            block = self.table[first + lo : first + lo + len(part)]
            block[:] = rows
            if tiled:
                self.tiles.add(block, tiled, of, self.at)
        self.fresh = []

    @staticmethod
    def words(piece: str, alphabet: str) -> list[str]:
        if piece.isalpha() and alphabet not in catalog.CJ_ALPHABETS:
            return [piece.replace("İ", "i").lower()[:LONGEST]]
        bare = re.sub("[0-9]", "", piece)
        if alphabet == "LATIN" and len(bare) < len(piece):
            return []
        word = bare.replace("İ", "i").lower()
        for c in APOSTROPHES:
            word = word.replace(c, "'")
        parts = [word[i : i + LONGEST_CJ] for i in range(0, len(word), LONGEST_CJ)] if alphabet in catalog.CJ_ALPHABETS else [word[:LONGEST]]
        return [w for w in (p.removesuffix("'") for p in parts) if w]

    def score(self, word: str, script: int, row: list) -> bool:
        """Adds what a word says to its row; true if its n-grams are still to be added by Tiles."""
        at, params, tiled = self.at, self.params, False
        if self.facts.has_cj and self.facts.alphabets[script] in catalog.CJ_ALPHABETS:
            self.score_cj(word, row)
        elif self.single[script] < 0:
            tiled = self.tiles.fits
            if self.tops is not None:
                if word in self.skips:
                    return False
                if len(word) > 1 or ord(word[0]) >= 128:
                    row[at.lookups.start + script] += 1
                    if word in self.tops:
                        self.hit(row, self.tops[word], at.tw_u.start, at.tw_hits.start)
                    elif len(word) > 2 and word[0] != "'" and 0 < (k := word.find("'", 1)) < len(word) - 1:
                        self.hit(row, self.tops.get(word[: k + 1], ()), at.tw_u.start, at.tw_hits.start)
                        if len(word) - k > 2:
                            row[at.lookups.start + script] += 1
                            self.hit(row, self.tops.get(word[k + 1 :], ()), at.tw_u.start, at.tw_hits.start)
            grams, size = self.grams, len(word)
            for n in range(0 if tiled else min(params.max_ngram, size), params.min_ngram - 1, -1):
                found = [grams.get(word[i : i + n]) for i in range(size - n + 1)]
                for g in found:
                    if g:
                        self.hit(row, g, at.ng_u.start, at.ng_hits.start)
                if n <= params.stop and None not in found:
                    break
        row[at.chars.start + script] += len(word)
        row[at.words.start + script] += 1
        return tiled

    def score_cj(self, word: str, row: list) -> None:
        at = self.at
        row[at.grams.start] += len(word)
        row[at.grams.start + 1] += len(word) - 1
        for i in range(len(word)):
            self.hit(row, self.cj.get(word[i], ()), at.uni_u.start, at.uni_hits.start)
            if i:
                self.hit(row, self.cj.get(word[i - 1 : i + 1], ()), at.bi_u.start, at.bi_hits.start)

    @staticmethod
    def hit(row: list, evidence: tuple, sums: int, hits: int) -> None:
        """evidence: (language, logarithm) pairs."""
        for lang, u in evidence:
            row[sums + lang] += u
            row[hits + lang] += 1


def totals(ev: np.ndarray, facts: Facts, boosts: dict[str, float] | None = None) -> np.ndarray:
    """Scores by text and language, before the scripts are looked at."""
    at = Layout(facts)

    def per_hit(u, hits, floor):
        most = hits.max(axis=1, initial=0)[:, None]
        missed = (u + (most - hits) * floor) / 1e6
        return np.where(most > 0, missed / np.maximum(most, 1), missed), most[:, 0]

    ng, _ = per_hit(ev[:, at.ng_u], ev[:, at.ng_hits], facts.floor_u)
    tw, most = per_hit(ev[:, at.tw_u], ev[:, at.tw_hits], facts.tw_floor_u)
    lookups = ev[:, at.lookups].sum(axis=1)
    r = np.where(lookups > 0, most / np.maximum(lookups, 1), 0.0)
    f = np.where(r < 0.5, r * 0.5, r * 0.8)[:, None]
    return boosted(np.where(f == 0, ng, ng * (1 - f) + tw * f), facts.languages, boosts)


def boosted(total: np.ndarray, languages, boosts: dict[str, float] | None) -> np.ndarray:
    return total + np.array([float((boosts or {}).get(x, 0.0)) for x in languages]) * np.abs(total)


def cj_totals(ev: np.ndarray, facts: Facts, boosts: dict[str, float] | None = None) -> np.ndarray:
    """Scores by text and Chinese or Japanese language: the mean logarithm of its characters and pairs, a miss costing the floor.
    0 for all if none of the grams is known."""
    at = Layout(facts)
    hits = ev[:, at.uni_hits] + ev[:, at.bi_hits]
    n = ev[:, at.grams].sum(axis=1)[:, None]
    total = (ev[:, at.uni_u] + ev[:, at.bi_u] + (n - hits) * CJ_FLOOR_U) / 1e6 / np.maximum(n, 1)
    return boosted(np.where(hits.sum(axis=1)[:, None] > 0, total, 0.0), [facts.languages[i] for i in facts.cj], boosts)


def first_two(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best column of each row (the first of equals), its value, and the next best value (nan without one)."""
    best = total.argmax(axis=1)
    t1 = total[np.arange(len(total)), best]
    rest = total.copy()
    rest[np.arange(len(total)), best] = -np.inf
    t2 = rest.max(axis=1)
    return best, t1, np.where(np.isinf(t2), np.nan, t2)


def decided(ev: np.ndarray, facts: Facts, boosts: dict[str, float] | None = None) -> dict[str, list]:
    """detected, gap, num_words, num_chars, num_lookups, pred of each text."""
    at, n = Layout(facts), len(ev)
    chars = ev[:, at.chars]
    weights = chars * np.array([catalog.ALPHABETS[a][0] for a in facts.alphabets])
    group = np.array([facts.has_cj and a in catalog.CJ_ALPHABETS for a in facts.alphabets])
    others = np.where(group[None, :], 0.0, weights)
    pred = np.where(others.max(axis=1, initial=0) > 0, others.argmax(axis=1), -1)
    names = np.array([*facts.languages, UNKNOWN], dtype=object)
    detected, gap = np.full(n, UNKNOWN, dtype=object), np.where(pred < 0, 1.0, 0.0)
    open_ = np.ones(n, dtype=bool)
    if facts.has_cj:
        han, kana = facts.alphabets.index("HAN"), facts.alphabets.index("JA_KANA") if "JA_KANA" in facts.alphabets else -1
        heavy = (weights * group).sum(axis=1) > others.max(axis=1, initial=0)
        k = chars[:, kana] if kana >= 0 else np.zeros(n, dtype=np.int64)
        kanas = heavy & (k / np.maximum(k + chars[:, han], 1) > KANA_SHARE)
        best, t1, t2 = first_two(cj_totals(ev, facts, boosts))
        known = heavy & ~kanas & (t1 != 0)
        detected[kanas], gap[kanas], pred[kanas] = "ja", 1.0, kana
        detected[known] = names[np.array(facts.cj)[best[known]]]
        gap[known] = np.where(np.isnan(t2[known]) | (t2[known] == 0), 0.0, 1 - t1[known] / np.where(t2[known] == 0, 1, t2[known]))
        pred[heavy & ~kanas], gap[heavy & ~kanas & ~known] = han, 0.0
        open_ = ~(kanas | known)
    total = totals(ev, facts, boosts)
    for s, a in enumerate(facts.alphabets):
        mine = np.flatnonzero(open_ & (pred == s))
        users = facts.users(a)
        if not len(mine):
            continue
        if len(users) == 1:
            detected[mine], gap[mine] = facts.languages[users[0]], 1.0
            continue
        best, t1, t2 = first_two(total[np.ix_(mine, users)])
        some = t1 != 0
        detected[mine[some]] = names[np.array(users)[best[some]]]
        with np.errstate(divide="ignore", invalid="ignore"):
            gap[mine[some]] = np.where((t2[some] == 0) | np.isnan(t2[some]), 0.0, 1 - t1[some] / t2[some])
    return {
        "detected": detected.tolist(),
        "gap": gap,
        "num_words": ev[:, at.words].sum(axis=1),
        "num_chars": chars.sum(axis=1),
        "num_lookups": ev[:, at.lookups].sum(axis=1),
        "pred": [facts.alphabets[p] if p >= 0 else "UNKNOWN" for p in pred.tolist()],
    }


RESULT = "detected string, gap double, num_words long, num_chars long, num_lookups long, pred string"
#: What a worker keeps between tasks: the tables of the last models it scored with.
_kept: dict[str, Pieces] = {}


def pieces_of(shared) -> Pieces:
    """shared: broadcast (key, facts, tables, params)."""
    key, *what = shared.value
    if key not in _kept:
        while len(_kept) > 1:
            _kept.pop(next(iter(_kept)))
        _kept[key] = Pieces(*what)
    return _kept[key]


def sliced(batches):
    """Batches of at most ROWS rows: of each only so many texts are Python strings at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def arrays(columns: dict[str, list]) -> list[pa.Array]:
    return [pa.array(v, type=pa.string() if isinstance(v, list) else None) for v in columns.values()]


def lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width) if width else np.zeros(n + 1), type=pa.int32()), pa.array(rows.ravel()))


def unlisted(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
