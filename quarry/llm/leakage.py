"""Evaluation passages inside a corpus.

One Aho-Corasick automaton holds short word runs of all normalised prompts and answers. A passage
of at least ``min_words`` = 2m words contains a whole aligned run of m words, so every leak is hit;
a hit is then extended letter by letter on both sides and counts if it spans ``min_words`` whole
words. Normalisation keeps letters and digits only, after entities, markup, invisible characters,
compatibility forms and case are folded, so spacing, punctuation and line prefixes make no
difference either; word borders are checked at the ends of a passage.

What is markup can be ambiguous (``a <b and c> d``, ``[text](address)``, numbered lines). A text that
holds such marks is read in each way, and a leak in any reading counts.
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of items per automaton (some 50 bytes of memory each); more items take further scans.
PASS_LETTERS = 4_000_000

_ATTRIBUTE = r"""\s+[\w:@.\-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=`]+)|\s+(?:async|autofocus|checked|controls|defer|disabled|hidden|ismap|loop|multiple|muted|nowrap|open|readonly|required|reversed|selected)(?=[\s/>])"""
_INLINE = r"(?:a|abbr|acronym|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)"
_INLINE_TAG = re.compile(rf"</?{_INLINE}(?:{_ATTRIBUTE})*\s*/?>", re.I)
_TAG = re.compile(rf"<!--.*?-->|<!\[CDATA\[|\]\]>|</?[a-z][\w:\-]*(?:{_ATTRIBUTE})*\s*/?>", re.I | re.S)
#: What a careless writer may have meant as a tag, and a careful one as text.
_LOOSE_TAG = re.compile(r"<[/!?]?[a-z][^<>]*>", re.I)
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
#: Marks of lighter languages that carry words or digits of their own.
_LIGHT = re.compile(
    r"(?m)(?<=\])\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"\n]*\")?\)|(?<=\])\[[^\[\]\n]*\]"  # [text](address), [text][name]
    r"|\[\^?\d+\]"  # [1], [^1]
    r"|\[/?(?:b|i|u|s|url|quote|code|size|color|font|center|list|img)(?:=[^\[\]\n]*)?\]"  # [b], [url=..]
    r"|\[\[[^\[\]|\n]*\|"  # [[target|text]]
    r"|\\(?:text(?:bf|it|tt|sc|rm|sf)|emph|underline|mbox|footnote)\b"  # \emph{..}
    r"|^[ \t]*(?:L?\d+[ \t]*[:.|)\]]|\d+\t|(?i:rem|dnl)[ \t])"  # numbered lines, word-like comment marks
)


@lru_cache(maxsize=1)
def _invisible() -> re.Pattern:
    """Format characters and others that Unicode says to ignore in display."""
    extra = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
    named = [chr(c) for c in range(0x30000) if unicodedata.category(chr(c)) == "Cf"]
    return re.compile("[" + "".join(map(re.escape, named)) + "".join(f"{chr(a)}-{chr(b)}" for a, b in extra) + "]")


_NOT_LETTER = re.compile(r"[\W_]+")
_DELETE = bytes(c for c in range(256) if not chr(c).isascii() or not chr(c).isalnum())
_LOWER = bytes(ord(chr(c).lower()) if c < 128 else c for c in range(256))


def _compat(s: str) -> str:
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", s).casefold())


def readings(text: str) -> list[tuple[bool, bool]]:
    """Ways to read a text: (loose tags are tags, light markup is markup)."""
    out = [(True, False)]
    if _LIGHT.search(text):
        out.append((True, True))
    if ("<" in text or "&" in text) and any(not _TAG.fullmatch(m[0]) for m in _LOOSE_TAG.finditer(_decode(text))):
        out += [(False, light) for _, light in list(out)]
    return out


def _decode(text: str) -> str:
    for _ in range(3):  # escaped once more by each system it passed
        if "&" not in text:
            break
        new = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
        if new == text:
            break
        text = new
    return text


def squash(text: str, loose: bool = True, light: bool = False) -> str:
    """Letters and digits of a text in folded form."""
    if not light and text.isascii() and "<" not in text and "&" not in text:
        return text.encode("ascii").translate(_LOWER, _DELETE).decode("ascii")
    s = _decode(text)
    if light:
        s = _LIGHT.sub("", s)
    if "<" in s or "]]>" in s:
        s = _TAG.sub(" ", _INLINE_TAG.sub("", s))
        if loose:
            s = _LOOSE_TAG.sub(" ", s)
    if s.isascii():
        s = s.lower()
    else:
        s = _compat(_invisible().sub("", s))
    return _NOT_LETTER.sub("", s)


class Origin:
    """Folded letters with their place in the original and whether each begins a word."""

    def __init__(self, text: str, loose: bool = True, light: bool = False):
        self.chars, self.a, self.z = list(text), list(range(len(text))), list(range(1, len(text) + 1))
        for _ in range(3):
            if "&" not in self.chars or not self._replace(_ENTITY, lambda m: html.unescape(m[0])):
                break
        if light:
            self._replace(_LIGHT, lambda m: "")
        if "<" in self.chars or "]" in self.chars:
            self._replace(_INLINE_TAG, lambda m: "")
            self._replace(_TAG, lambda m: " ")
            if loose:
                self._replace(_LOOSE_TAG, lambda m: " ")
        if not all(map(str.isascii, self.chars)):
            self._replace(_invisible(), lambda m: "")
        letters: list[str] = []
        self.start: list[int] = []
        self.stop: list[int] = []
        self.begins: list[bool] = []
        border, i, n = True, 0, len(self.chars)
        while i < n:
            j = i + 1
            while j < n and not self.chars[j].isascii() and _joins(self.chars[j]):
                j += 1
            # a base character with its marks is folded as one and keeps one place
            unit = "".join(self.chars[i:j])
            for c in unit.lower() if unit.isascii() else _compat(unit):
                if c.isalnum():
                    letters.append(c)
                    self.start.append(self.a[i])
                    self.stop.append(self.z[j - 1])
                    self.begins.append(border)
                    border = False
                elif not unicodedata.category(c).startswith("M"):
                    border = True
            i = j
        self.letters = "".join(letters)

    def _replace(self, pattern: re.Pattern, by) -> bool:
        s = "".join(self.chars)
        chars, a, z, pos, changed = [], [], [], 0, False
        for m in pattern.finditer(s):
            i, j, new = m.start(), m.end(), by(m)
            if new == m[0]:
                continue
            changed = True
            chars += self.chars[pos:i] + list(new)
            a += self.a[pos:i] + [self.a[i]] * len(new)
            z += self.z[pos:i] + [self.z[j - 1]] * len(new)
            pos = j
        if changed:
            self.chars, self.a, self.z = chars + self.chars[pos:], a + self.a[pos:], z + self.z[pos:]
        return changed


def _joins(c: str) -> bool:
    """Marks and the later parts of a Hangul syllable, which compose with what precedes them."""
    return unicodedata.category(c).startswith("M") or "ᅠ" <= c <= "ᇿ"


def words(text: str) -> list[str]:
    o = Origin(text)
    cut = [i for i, b in enumerate(o.begins) if b] + [len(o.letters)]
    return [o.letters[a:b] for a, b in zip(cut, cut[1:])]


@dataclass
class Passage:
    item: int
    field: int
    letters: str
    starts: list[int]  # letter offset of every word, and the end


class Screen:
    """Automaton over aligned word runs of the items' fields."""

    def __init__(self, items: list[tuple[int, list[str | None]]], min_words: int):
        self.min_words = min_words
        self.passages: list[Passage] = []
        runs: dict[str, list[tuple[int, int]]] = {}
        m = max(1, min_words // 2)
        for item, fields in items:
            for f, text in enumerate(fields):
                w = words(text or "")
                if len(w) < min_words:
                    continue
                starts = [0]
                for x in w:
                    starts.append(starts[-1] + len(x))
                self.passages.append(Passage(item, f, "".join(w), starts))
                for b in range(0, len(w) - m + 1, m):
                    runs.setdefault("".join(w[b : b + m]), []).append((len(self.passages) - 1, starts[b]))
        self.automaton = ahocorasick.Automaton()
        for run, where in runs.items():
            self.automaton.add_word(run, (len(run), where))
        if runs:
            self.automaton.make_automaton()
        self.empty = not runs

    def search(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, field, words, from, to) of every leaked passage, offsets in the original text."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if self.empty:
            return []
        for loose, light in readings(text):
            if next(self.automaton.iter(squash(text, loose, light)), None) is not None:
                self._extend(Origin(text, loose, light), best)
        return [(item, f, n, a, b) for (item, f), (n, a, b) in best.items()]

    def _extend(self, o: Origin, best: dict) -> None:
        letters, begins = o.letters, o.begins
        reached: dict[tuple[int, int], int] = {}  # how far an alignment of a passage has been followed
        for e, (n, where) in self.automaton.iter(letters):
            for p, offset in where:
                q, shift = self.passages[p], e - n + 1 - offset
                if reached.get((p, shift), -1) > offset:
                    continue
                lo, hi, size = offset, offset + n, len(q.letters)
                while hi < size and hi + shift < len(letters) and q.letters[hi] == letters[hi + shift]:
                    hi += 1
                while lo > 0 and lo - 1 + shift >= 0 and q.letters[lo - 1] == letters[lo - 1 + shift]:
                    lo -= 1
                reached[p, shift] = hi
                inside = [i for i, s in enumerate(q.starts) if lo <= s <= hi and (s + shift == len(letters) or begins[s + shift])]
                if inside and (span := inside[-1] - inside[0]) >= self.min_words:
                    a, b = q.starts[inside[0]] + shift, q.starts[inside[-1]] + shift - 1
                    key = (q.item, q.field)
                    if key not in best or best[key][0] < span:
                        best[key] = (span, o.start[a], o.stop[b])


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("field", pa.string()), ("words", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())])
_DDL = "doc_id long, item_id long, field string, words int, begin int, end int"


def leaked_passages(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, fields: list[str], min_words: int = 12, pass_letters: int = PASS_LETTERS) -> DataFrame:
    """Columns ``doc_id, item_id, field, words, begin, end``: the longest leak per document, item and field.

    Null and empty texts, null ids and items with fewer than ``min_words`` words match nothing. The
    automaton is built once, at the driver, and sent to the executors. Items of more than
    ``pass_letters`` characters in all are cut into automata of that size, each a scan of its own;
    a test set fits one.
    """
    texts = [F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)]
    keyed = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), *texts)
    size = sum((F.coalesce(F.length(f"f{k}"), F.lit(0)) for k in range(len(fields))), F.lit(0))
    passes = max(1, -(-(keyed.agg(F.sum(size)).first()[0] or 0) // pass_letters))
    out = None
    for n in range(passes):
        rows = keyed.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == n).collect()
        screen = Screen([(r["i"], [r[f"f{k}"] for k in range(len(fields))]) for r in rows], min_words)
        found = _scan(docs, docs.sparkSession.sparkContext.broadcast(pickle.dumps(screen)), id_col, text_col, fields)
        out = found if out is None else out.unionByName(found)
    return out


#: The automaton that this worker process used last, under the key of its scan.
_HELD: dict[str, Screen] = {}


def _screen(key: str, held) -> Screen:
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = pickle.loads(held.value)
    return _HELD[key]


def _scan(docs: DataFrame, held, id_col: str, text_col: str, fields: list[str]) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]):
        screen = _screen(key, held)
        for b in batches:
            rows = []
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                rows += [(doc, item, fields[f], n, x, y) for item, f, n, x, y in screen.search(text)]
            if rows:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    src = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, _DDL)
