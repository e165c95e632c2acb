"""Noise of scanned pages: running titles, page numbers, words broken at line ends, characters taken for others.

Method for misread characters: the words of all body lines are counted; a symmetric-delete index over the frequent ones
gives candidates for every word, a weighted edit distance that knows confusion pairs ranks them, and how often the
candidate and the word stand between their neighbours (bigrams) decides. In scripts without spaces a character is the
word, and its neighbours on both sides are the context.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.confusions import GAP, OTHER, PAIR, confusion_distance, partners
from foliospark.llm.reading import VOCABULARY_WORDS, Canonical, canonical_vocabulary, reading, with_rest
from foliospark.session import bounded_broadcast, by_key, checkpoint, written

#: A running title stands on at least this share of its source's pages, and on TITLE_PAGES.
TITLE_SHARE, TITLE_PAGES = 0.08, 3
#: Occurrences from which a word is a candidate for correction.
KNOWN = 4
#: What a word's candidate must have of its own occurrences.
RATIO = 6
#: Logarithmic evidence that makes a word, or a character of a dense script, misread.
WORD_EVIDENCE, CHAR_EVIDENCE = 1.2, 3.0
#: Sources whose titles are sent to all workers, at most.
SENT_SOURCES = 100_000
#: Words with candidates that are sent to all workers, at most.
SENT_WORDS = 500_000
#: Pairs of neighbouring characters of dense scripts that are sent to all workers, at most; beyond, joins judge them.
CHAR_PAIRS = 2_000_000
#: Frequent rough keys of titles that are broadcast, after they have been counted; beyond, a shuffle joins them.
ROUGH_KEYS = 1_000_000

# Signs of a word that goes on in the next line.
BREAK_MARKS = "-‐‑‒=¬­"
_MARK_SET = frozenset(BREAK_MARKS)
_BEFORE_MARK = regex.compile(r"[\p{L}\p{M}\p{Nd}]\p{Cf}*$")

_SPACED = r"\p{Latin}\p{Cyrillic}\p{Greek}\p{Devanagari}"
_DENSE = r"\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}"
_LETTER, _DENSE_CHAR = re.compile("[A-Za-z]"), re.compile("[\u0e01-\u0e4f\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002fa1f]")
_IS_SPACED, _IS_DENSE = regex.compile(f"[{_SPACED}]"), regex.compile(f"[{_DENSE}]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
_TOKEN, _ASCII_TOKEN = regex.compile(r"[\p{L}\p{M}\p{Nd}]+|\n"), re.compile(r"[a-z0-9]+|\n")
_ASCII_WORD, _ASCII_FIRST = re.compile("[a-z0-9]+"), re.compile("[A-Za-z0-9]+")
_INVISIBLE_END = regex.compile(r"[\s\p{Zs}\p{Cf}--­]+$", regex.V1)
# Signs around a page number: dashes, bars and points, or a pair of brackets; commas and single brackets are body text.
_AROUND = regex.compile(r"^[\s\p{Pd}|·•*~=_]*(?:\[(.*)\]|〔(.*)〕|\((.*)\)|［(.*)］|【(.*)】|([^\[\]〔〕()（）,;:，；：]*?))[\s\p{Pd}|·•*~=_.。]*$")
_CJK_DIGITS = "〇○零一二三四五六七八九十百千廿卅"
_NUMBER = regex.compile(
    r"^(?:"
    r"(?=.*\p{Nd})[\p{Nd}lIiOoSsBbZzGgqTt|]{1,5}|[lIO]{2,3}"
    rf"|[第弟]?[{_CJK_DIGITS}\p{{Nd}}人入土士于千]{{1,8}}[丁葉頁页]?"
    r"|[ftFT1l][o0OQ][l1iIt][.,]?\s*[\p{Nd}lIOoSsBZz]{1,4}\s*[rvRVya]?"
    r")$"
)
_ROMAN = regex.compile(r"^(?=.)m{0,4}(?:cm|cd|d?c{0,5})(?:xc|xl|l?x{0,5})(?:ix|iv|v?i{0,5})$")
_ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_FINAL = frozenset(".!?…。,;:、”»」“)।॥○")
# A number without the signs around it has 22 characters at most (mmmm dccccc lxxxxx viiiii); longer ones are none.
_NUMBER_CHARS = 22
_AROUND_SIGNS = " |·•*~=_.。[]〔〕()（）［］【】" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Pd")
#: What words may hold that is_number takes for numbers: what is left of a title without them stays in its key.
_NUMERALS = frozenset("0123456789lioszbgqtvxcdmfolrya" + _CJK_DIGITS + "人入土士于第弟丁葉頁页")
_NUMBER_ENDS = "".join(_NUMERALS | set("LIOSBZGQTVXCDMFRYA")) + _AROUND_SIGNS + ",;:!?'\"’‘"
_NUMBER_WORD = re.compile(rf"[\dlIiOoSsBbZzGgqTtvxcdm|{_CJK_DIGITS}人入土士于第弟丁葉頁页]+$")
#: Signs that part the words of a title.
_SIGNS = {ord(c): " " for c in map(chr, range(0x10000)) if c == "|" or unicodedata.category(c).startswith("P")}


def roman(word: str) -> int:
    """Value of a roman number, also of an additive one (xxviiii); 0 if it is none."""
    w = word.casefold().replace("1", "i")
    if not _ROMAN.match(w):
        return 0
    values = [_ROMAN_VALUES[c] for c in w]
    return sum(-v if any(x > v for x in values[k + 1 :]) else v for k, v in enumerate(values))


def is_number(read: str) -> bool:
    """Whether a line holds only a page or leaf number, in any script and with the signs around it."""
    if len(read) > _NUMBER_CHARS and len(read.strip(_AROUND_SIGNS)) > _NUMBER_CHARS:
        return False
    m = _AROUND.match(read)
    core = next((x for x in m.groups() if x is not None), "").strip() if m else ""
    if not core:
        return False
    if _NUMBER.match(core):
        return not (len(core) == 1 and core in "iloOT")
    return 0 < roman(core) < 500


def title_key(read: str) -> str:
    """What a running title has in common on all pages: without numbers, signs and case."""
    words = _ASCII_WORD.findall(read.lower()) if read.isascii() else read.casefold().translate(_SIGNS).split()
    while len(words) > 1 and _NUMBER_WORD.match(words[-1]) and is_number(words[-1]):
        words.pop()
    while len(words) > 1 and _NUMBER_WORD.match(words[0]) and is_number(words[0]):
        words.pop(0)
    return " ".join(words)


def _kind(read: str) -> str:
    """Whether most letters are of scripts with spaces between words, or of dense ones."""
    if read.isascii():
        return "spaced" if _LETTER.search(read) else "none"
    if not _DENSE_CHAR.search(read):
        return "spaced" if _IS_SPACED.search(read) else "none"
    if not _IS_SPACED.search(read):
        return "dense"
    return "spaced" if len(_IS_SPACED.findall(read)) >= len(_DENSE_CHAR.findall(read)) else "dense"


def running_titles(rows: DataFrame, all_pages: DataFrame, share: float = TITLE_SHARE, pages: int = TITLE_PAGES) -> DataFrame:
    """(source_id, titles): the keys of lines that stand on many pages of a source. At most 1 / share a line place.

    ``rows``: source_id, page_id, title, final of candidate lines; ``all_pages``: source_id, page_id of all."""
    per_source = all_pages.select("source_id", "page_id").distinct().groupBy("source_id").agg(F.count("*").alias("all_pages"))
    keys = (
        rows.where("length(title) >= 2 and not final")
        .select("source_id", "title", "page_id")
        .distinct()
        .groupBy("source_id", "title")
        .agg(F.count("*").alias("n_pages"))
        .where(F.col("n_pages") >= pages)
    )
    return (
        keys.join(per_source, "source_id")
        .where(F.col("n_pages") >= share * F.col("all_pages"))
        .groupBy("source_id")
        .agg(F.sort_array(F.collect_set("title")).alias("titles"))
    )


@lru_cache(maxsize=10_000)
def _letters(title: str) -> frozenset[str]:
    return frozenset(title)


def _near(a: str, b: str, most: int) -> bool:
    """Whether so few single edits part two strings."""
    if abs(len(a) - len(b)) > most:
        return False
    # An edit changes which letters there are, and how often they occur, by two at most.
    if len(set(a) ^ _letters(b)) > 2 * most or sum(abs(a.count(c) - b.count(c)) for c in set(b)) > 2 * most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return False
    return row[-1] <= most


def is_title(key: str, titles: list[str], edge: bool, final: bool) -> bool:
    """Whether a line's key is a title of its source: the same, misread, or its first words (``edge``: the line is the
    first or last of its page or next to a number, and no small letter begins it)."""
    if len(key) < 2:
        return False
    for t in titles:
        if key == t or _near(key, t, max(1, len(t) // 5)):
            return True
        if len(key) < len(t) and not final:
            head = t[: len(key)]
            whole = t[len(key)] == " " or not t.isascii()
            ends = key[:3] == head[:3] or key[-3:] == head[-3:]  # a single edit leaves one of them
            if whole and ends and (edge or " " in key) and (key == head or (len(key) >= 6 and _near(key, head, 1))):
                return True
    return False


#: What a rough key leaves out: everything but letters, and the letters and ideographs with which numbers are written.
_NOT_ROUGH = r"[[^\p{L}]ivxlcdm" + _CJK_DIGITS + "]+"


def may_be_title(read: str, longest: int) -> bool:
    """Whether a line's key may have so few characters: what is no number or sign at its ends stays in it."""
    return len(read) <= longest or sum(map(str.isalnum, read.strip(_NUMBER_ENDS))) <= longest


def _rough_key(text: Column) -> Column:
    """What a title's clean spellings have in common, by built-in functions alone: letters, without those of numerals.
    Other lines may share it."""
    return F.regexp_replace(F.lower(text), _NOT_ROUGH, "")


def _title_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for source, page, text in zip(b["source_id"], b["page_id"], b["text"], strict=True):
            read = reading(text)
            if read and not is_number(read):
                out.append((source, page, title_key(read), read[-1] in _FINAL))
        yield pd.DataFrame(out, columns=["source_id", "page_id", "title", "final"])


def titles_of_lines(lines: DataFrame) -> DataFrame:
    """running_titles of raw lines. Lines are first grouped by the hash of a rough key; only those whose key stands on two
    pages of a source or more pass through Python for their exact key. No line is shuffled for that unless the frequent
    keys are more than ROUGH_KEYS."""
    # Lines that end with a mark are no titles.
    open_ = lines.where(~F.right(F.rtrim("text"), F.lit(1)).isin(*_FINAL))
    rough = F.xxhash64("source_id", _rough_key(F.col("text")))
    page = F.xxhash64("page_id")
    often = (
        open_.select(rough.alias("rough"), page.alias("page"))
        .groupBy("rough")
        .agg(F.min("page").alias("x"), F.max("page").alias("y"))
        .where("x <> y")
        .select("rough")
    )
    often = bounded_broadcast(checkpoint(often), ROUGH_KEYS)
    some = open_.select("source_id", "page_id", "text", rough.alias("rough")).join(often, "rough", "left_semi").select("source_id", "page_id", "text")
    rows = some.mapInPandas(_title_rows, "source_id string, page_id string, title string, final boolean")
    return running_titles(rows, lines.select("source_id", "page_id"))


#: Different keys that a Python worker counts before it hands them on.
_COUNTED = 400_000

_PASS = (
    "line_id long, head boolean, number boolean, kind string, read string, marked boolean, final boolean, next_id long, "
    "next_first string, was_marked boolean, last_char string, what string, key string, n long"
)
_LINE = [x.split()[0] for x in _PASS.split(", ")][:11]


def _is_short_number(text: str) -> bool:
    return is_number(reading(text))


class _Counts:
    """Counts of words, of words at a line's ends, and of neighbours, over many lines at a time: words become numbers, and
    numbers are counted as arrays."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {"\n": 0}
        self.words: list[np.ndarray] = []  # (word, count), and so on
        self.ends: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []
        self.chars: list[np.ndarray] = []

    def __len__(self) -> int:
        return len(self.ids) + sum(len(x) for x in (*self.pairs, *self.chars))

    def add_lines(self, texts: list[str], marked: list[bool], pattern) -> None:
        """Counts the words of lines; of a marked line the last word is no end, being whole."""
        if not texts:
            return
        ids = self.ids
        w = np.array([0] + [ids.setdefault(x, len(ids)) for x in pattern.findall("\n".join(texts))] + [0])
        self.words.append(_tally(w[w > 0]))
        at = np.flatnonzero(w == 0)
        some = np.diff(at) > 1
        first, last = at[:-1][some] + 1, at[1:][some] - 1
        last = last[(last > first) & ~np.array(marked)[some]] if len(first) else last
        self.ends.append(_tally(np.concatenate([w[first], w[last]])))
        both = (w[:-1] > 0) & (w[1:] > 0)
        self.pairs.append(_tally(w[:-1][both] << 32 | w[1:][both]))

    def add_dense(self, texts: list[str]) -> None:
        """Counts characters that follow each other."""
        if texts:
            c = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            both = (c[:-1] != 10) & (c[1:] != 10)
            self.chars.append(_tally(c[:-1][both] << 32 | c[1:][both]))

    def rows(self) -> list[tuple[str, str, int]]:
        names = list(self.ids)
        low = (1 << 32) - 1
        out = [(what, names[k], int(n)) for what, parts in (("w", self.words), ("e", self.ends)) for k, n in _total(parts)]
        out += [("b", f"{names[k >> 32]} {names[k & low]}", int(n)) for k, n in _total(self.pairs)]
        return out + [("c", chr(k >> 32) + chr(k & low), int(n)) for k, n in _total(self.chars)]


def _tally(keys: np.ndarray) -> np.ndarray:
    return np.stack(np.unique(keys, return_counts=True), axis=1)


def _total(parts: list[np.ndarray]) -> list[list[int]]:
    if not parts:
        return []
    both = np.concatenate(parts)
    keys, at = np.unique(both[:, 0], return_inverse=True)
    return list(zip(keys.tolist(), np.bincount(at, both[:, 1]).astype(np.int64).tolist(), strict=True))


class _Pages:
    """Reads lines in page order, one line ahead: what each is, what stands beside it, and what its words count."""

    def __init__(self, titles: dict[str, list[str]]):
        self.titles, self.known = titles, {}
        self.page: object = self
        self.held: tuple | None = None  # the line that is next to be judged
        self.first = True  # no line before on this page, or a number
        self.body: list | None = None  # the last body line, which waits for the next one
        self.out: list[list] = []
        self.counts = _Counts()
        self.plain, self.other, self.dense = ([], []), ([], []), []  # texts to be counted, and whether they are marked

    def of(self, source) -> tuple[list[str], int, frozenset[str], int]:
        """A source's titles; how long the key of a line can be that is one of them; the letters that such a line may have,
        with those of numbers and signs; and how many others, misread ones."""
        if source not in self.known:
            titles = self.titles.get(source) or []
            edits = max((max(1, len(t) // 5) for t in titles), default=0)
            self.known[source] = (titles, max((len(t) for t in titles), default=0) + edits, _NUMERALS.union(*titles), edits)
        return self.known[source]

    def add(self, page, line_id, source, text) -> None:
        if page != self.page:
            self.end_page()
            self.page, self.first = page, True
        elif self.held is not None and self.held[0] == line_id:
            return
        if self.held is not None:
            self.judge(False, text)
        self.held = (line_id, source, text)

    def end_page(self) -> None:
        if self.held is not None:
            self.judge(True)
        self.held = None
        if self.body is not None:
            self.emit(None, None)
        self.body = None

    def judge(self, is_last: bool, behind: str = "") -> None:
        line_id, source, text = self.held
        raw = text.rstrip()
        if not raw.isascii():
            raw = _INVISIBLE_END.sub("", raw)
        marked = raw[-1:] in _MARK_SET and bool(_BEFORE_MARK.search(raw[-8:-1]))
        read = reading(raw[:-1] if marked else raw)
        if not read and not marked:
            return
        final = read[-1:] in _FINAL
        if not marked and is_number(read):
            self.out.append([line_id, False, True, "none", read, marked, final, None, None, False, None])
            self.first = True
            return
        edge, self.first = self.first or is_last, False
        titles, longest, letters, edits = self.of(source)
        if titles and not marked and not final and self.is_head(read, titles, longest, letters, edits, edge, behind):
            self.out.append([line_id, True, False, "none", read, marked, final, None, None, False, None])
            return
        kind = _kind(read)
        before = self.body
        if before is not None:
            if before[3] == "dense":
                nxt = read[:1]
            else:
                m = _ASCII_FIRST.match(read) if read.isascii() else _WORD.match(read)
                nxt = m.group() if m else ""
            self.emit(line_id, nxt)
        last_char = before[4][-1:] if before is not None and kind == "dense" else None
        self.body = [line_id, False, False, kind, read, marked, final, None, None, before is not None and before[5], last_char]

    def is_head(self, read: str, titles: list[str], longest: int, letters: frozenset[str], edits: int, edge: bool, behind: str) -> bool:
        # Most body lines have too many letters for a title with a number, or letters that no title has.
        if not may_be_title(read, longest):
            return False
        if not read.isascii() and len({c for c in set(read.casefold()) - letters if c.isalpha()}) > edits:
            return False
        key = title_key(read)
        if len(key) > longest or not is_title(key, titles, True, False):
            return False
        return is_title(key, titles, (edge or _is_short_number(behind)) and not read[:1].islower(), False)

    def emit(self, next_id, nxt) -> None:
        """Hands on the waiting body line, and counts its words or characters."""
        line = self.body
        line[7], line[8] = next_id, nxt
        self.out.append(line)
        read, marked = line[4], line[5]
        if line[3] == "dense":
            self.dense.append(_with_edges(read, line[10], nxt))
        elif line[3] == "spaced":
            text = countable_text(read, marked, nxt, line[9])
            texts, marks = self.plain if text.isascii() else self.other
            texts.append(text)
            marks.append(marked)

    def batches(self, end: bool) -> Iterator[pa.RecordBatch]:
        """The lines that are ready, and the counts if they are many or the end is there."""
        if self.out:
            yield _batch(dict(zip(_LINE, zip(*self.out, strict=True), strict=True)), len(self.out))
            self.out = []
        counts = self.counts
        counts.add_lines(*self.plain, _ASCII_TOKEN)
        counts.add_lines(*self.other, _TOKEN)
        counts.add_dense(self.dense)
        self.plain, self.other, self.dense = ([], []), ([], []), []
        if end or len(counts) > _COUNTED:
            rows = counts.rows()
            counts.clear()
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                yield _batch(dict(zip(("what", "key", "n"), zip(*part, strict=True), strict=True)), len(part))


_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
_FIELDS = {x.split()[0]: _ARROW[x.split()[1]] for x in _PASS.split(", ")}


def _batch(columns: dict[str, tuple], n: int) -> pa.RecordBatch:
    """A record batch of the page pass; columns that are not given are null."""
    arrays = [pa.array(columns[name], kind) if name in columns else pa.nulls(n, kind) for name, kind in _FIELDS.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(_FIELDS))


def _pages(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = _Pages({} if shared is None else shared.value)
        for b in batches:
            column = {name: b.column(name).to_pylist() for name in b.schema.names}
            if shared is None:
                pages.titles.update((s, t) for s, t in zip(column["source_id"], column["titles"], strict=True) if t is not None)
            for page, line_id, source, text in zip(*(column[x] for x in ("page", "line_id", "source_id", "text")), strict=True):
                pages.add(page, line_id, source, text)
            yield from pages.batches(False)
        pages.end_page()
        yield from pages.batches(True)

    return run


def read_pages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each line once, with ``head`` and ``number``, and for body lines what stands next to them on the page, titles and
    numbers left out; and the counts (what, key, n) of words (w), of words at a line's ends (e), of neighbours (b) and
    of characters' neighbours (c).

    Texts are shuffled once, by page, and read once, in order; the result is written. Null and invisible texts are left
    out. Titles go to all workers at once, or with the rows where the sources are too many for that.
    """
    titles = checkpoint(titles_of_lines(lines))
    few = titles.limit(SENT_SOURCES + 1).count() <= SENT_SOURCES
    shared = lines.sparkSession.sparkContext.broadcast({r["source_id"]: list(r["titles"]) for r in titles.toLocalIterator()}) if few else None
    # Lines without a result are those of their page; without a page, too, each is a page of its own.
    page = F.coalesce("result_id", F.when(F.col("page_id").isNotNull(), F.xxhash64("source_id", "page_id")), F.xxhash64("line_id"))
    rows = lines.where("line_id is not null and text is not null").select(page.alias("page"), "reading_order", "line_id", "source_id", "text")
    if not few:
        rows = rows.join(titles, "source_id", "left")
    ordered = by_key(rows, "page").sortWithinPartitions("page", "reading_order", "line_id").drop("reading_order")
    both = written(ordered.mapInArrow(_pages(shared), _PASS))
    # Pairs seen once say nothing and are left out.
    sums = both.where("what is not null").groupBy("what", "key").agg(F.sum("n").alias("n")).where("what in ('w', 'e') or n > 1")
    return both.where("line_id is not null").select(*_LINE), written(sums)


def countable_text(read: str, marked: bool, next_first: str | None, was_marked: bool) -> str:
    """The words of a line as one text: a word broken at its end is whole, and the rest of one that the line before began
    is left out."""
    text = read.lower() if read.isascii() else read.casefold()
    if was_marked and text[:1].isalnum():
        first = (_ASCII_FIRST if text.isascii() else _WORD).match(text).group()
        if _countable(first):
            text = text[len(first) :]
    if marked and next_first and _countable(next_first) and text:
        text += next_first.casefold()
    return text


def _countable(w: str) -> bool:
    return not w.isdigit() and any(c.isalpha() for c in w)


_DIGIT = re.compile(r"\d")


def _with_edges(read: str, last: str | None, nxt: str | None) -> str:
    """A dense line between the characters before and behind it, digits alike."""
    return (last or "^") + _DIGIT.sub("0", read) + (nxt or "$")


def _delete_index(words: DataFrame) -> DataFrame:
    """(key, word, n): the word, and what is left of it without a letter or without two that follow each other."""
    size = F.length("word")
    at = F.sequence(F.lit(1), size)

    def without(k: int) -> Column:
        return F.transform(at, lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + k, size)))

    keys = F.array_distinct(F.concat(F.array("word"), without(1), without(2)))
    return words.select(F.explode(keys).alias("key"), "word", "n").where("key <> ''")


#: The dearest single edit: a substitution that no table has, a letter too many or too few.
EDIT = max(2 * PAIR, OTHER, GAP)


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        cost = [confusion_distance(w, c, EDIT) for w, c in zip(b["word"], b["meant"], strict=True)]
        b = b.assign(cost=cost)
        yield b[b["cost"] <= EDIT + 1e-9]


def corrections(words: DataFrame, known: int = KNOWN, ratio: float = RATIO) -> DataFrame:
    """(word, n, meant, n_meant, cost): the candidates of each word, from the symmetric-delete index, also by an edit that no table has.

    ``words``: word, n, inside. Candidates are words seen inside lines ``known`` times or more, without digits, and
    ``ratio`` times as often as the word.
    """
    lexicon = words.where((F.col("inside") >= known) & (F.col("n") >= ratio) & ~F.col("word").rlike("\\p{Nd}")).select("word", "n")
    size = F.length("word")
    read = words.where((size >= 2) & ~F.col("word").rlike("^\\p{Nd}+$")).select("word", "n")
    index = _delete_index(lexicon).select("key", F.col("word").alias("meant"), F.col("n").alias("n_meant"))
    asked = _delete_index(read)
    pairs = asked.join(index, "key").where((F.col("n_meant") >= ratio * F.col("n")) & (F.col("word") != F.col("meant"))).drop("key").distinct()
    return pairs.mapInPandas(_measure, "word string, n long, meant string, n_meant long, cost double")


class _Neighbours:
    """How often characters follow each other, and which one the neighbours of a place speak for."""

    def __init__(self, pairs: dict[str, int]):
        self.behind: dict[str, dict[str, int]] = {}
        self.before: dict[str, set[str]] = {}
        for pair, n in pairs.items():
            self.behind.setdefault(pair[0], {})[pair[1]] = n
            self.before.setdefault(pair[1], set()).add(pair[0])
        self.total = {c: sum(x.values()) for c, x in self.behind.items()}
        self.top: dict[tuple[str, str], list[tuple[float, str]]] = {}

    def n(self, a: str, b: str) -> int:
        return self.behind.get(a, {}).get(b, 0)

    def between(self, left: str, right: str) -> list[tuple[float, str]]:
        """The dense characters seen behind ``left`` and before ``right``, by their bigrams and against how frequent they
        are anyway, the best first."""
        found = self.top.get((left, right))
        if found is None:
            if len(self.top) >= 100_000:
                self.top.clear()
            after, before = self.behind.get(left, {}), self.before.get(right, set())
            both = [(log(after[y] + 0.5) + log(self.n(y, right) + 0.5) - log(self.total[y]), y) for y in before & after.keys() if _IS_DENSE.match(y)]
            self.top[left, right] = found = sorted(both, key=lambda x: (-x[0], x[1]))
        return found

    def meant(self, left: str, x: str, right: str, listed: dict[str, list[str]], evidence: float) -> list[str]:
        """The characters for which ``x`` may stand: its ``listed`` partners, else the best of all others, which costs
        more, and the more of them its neighbours admit."""
        if not _DENSE_CHAR.match(x):
            return []
        n, own = self.n, listed.get(x, ())
        had = log(max(n(left, x) - 1, 0) + 0.5) + log(max(n(x, right) - 1, 0) + 0.5)
        if out := [y for y in own if log(n(left, y) + 0.5) + log(n(y, right) + 0.5) - had >= evidence]:
            return out
        others = self.between(left, right)
        score, y = next((o for o in others if o[1] != x and o[1] not in own), (0.0, ""))
        cost = 2 * (OTHER - PAIR) + log(max(len(others), 1))
        return [y] if y and score + log(max(self.total.get(x, 0), 1)) - had - cost >= evidence else []


_held: dict[str, object] = {}

_USE = "line_id long, next_id long, word string, meant string, cut int, before string, behind string"
_USE_NAMES = [x.split()[0] for x in _USE.split(", ")]
_USE_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]


def _threes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All three neighbouring characters of texts whose middle one is dense, as one number each (21 bits a character); of
    each the text and the place of the middle one."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    breaks = np.flatnonzero(codes == 10)
    middle = _is_dense_code(codes[1:-1]) & (codes[:-2] != 10) & (codes[2:] != 10)
    at = np.flatnonzero(middle) + 1
    text = np.searchsorted(breaks, at)
    starts = np.concatenate([[0], breaks + 1])
    return codes[at - 1] << 42 | codes[at] << 21 | codes[at + 1], text, at - starts[text] - 1


_DENSE_CODES = [(0x0E01, 0x0E4F), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)]


def _is_dense_code(codes: np.ndarray) -> np.ndarray:
    """The codes that _DENSE_CHAR matches."""
    out = np.zeros(len(codes), bool)
    for low, high in _DENSE_CODES:
        out |= (codes >= low) & (codes <= high)
    return out


def _characters(three: int) -> str:
    return chr(three >> 42) + chr(three >> 21 & 0x1FFFFF) + chr(three & 0x1FFFFF)


def _listed() -> dict[str, list[str]]:
    """Dense characters and the dense ones for which they may stand, by the tables."""
    return {c: [x for x in others if _IS_DENSE.match(x)] for c, others in partners().items() if _IS_DENSE.match(c)}


def _dense_columns(b: pa.RecordBatch) -> tuple[list[int], list[str]]:
    """Ids and texts between their edges of a batch's dense lines."""
    dense = b.filter(pc.equal(b.column("kind"), "dense"))
    ids, *parts = (dense.column(x).to_pylist() for x in ("line_id", "read", "last_char", "next_first"))
    # A line break within a line would part its characters; texts have none, readings being one line.
    return ids, [_with_edges(*x) for x in zip(*parts, strict=True)]


def _uses(words, lexicon, pairs, key: str, evidence: float):
    """Of spaced lines the words that have candidates, each between its neighbours (``words``: those words, None for all),
    and lines whose last word goes on without a mark (word is empty; ``lexicon``: how often words stand inside lines;
    None: all lines whose last word may go on, as unmarked_breaks needs them); of dense lines the characters that stand for
    others (``pairs``: how often characters follow each other; None: all characters, as judged_threes needs them)."""
    swap = _listed()

    def dense(b: pa.RecordBatch, near, judged: dict[int, list[str]]) -> list[tuple]:
        ids, texts = _dense_columns(b)
        if not texts:
            return []
        threes, text, at = _threes(texts)
        if near is None:
            return [(ids[i], -1, c[1], "", k, c[0], c[2]) for i, k, c in zip(text.tolist(), at.tolist(), map(_characters, threes.tolist()), strict=True)]
        different, which = np.unique(threes, return_inverse=True)
        bad = np.zeros(len(different), bool)
        for n, three in enumerate(different.tolist()):
            meant = judged.get(three)
            if meant is None:
                judged[three] = meant = near.meant(*_characters(three), swap, evidence)
            bad[n] = bool(meant)
        out = []
        for i in np.flatnonzero(bad[which]).tolist():
            c = _characters(int(threes[i]))
            out += [(ids[text[i]], -1, c[1], y, int(at[i]), c[0], c[2]) for y in judged[int(threes[i])]]
        if len(judged) >= 300_000:
            judged.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _held:
            _held.clear()
            _held[key] = (*(None if x is None else x.value for x in (words, lexicon)), None if pairs is None else _Neighbours(pairs.value))
        wanted, known, near = _held[key]
        judged: dict[int, list[str]] = {}  # three characters to what the middle one stands for
        for b in batches:
            out = dense(b, near, judged)
            b = b.filter(pc.not_equal(b.column("kind"), "dense"))
            for line, nxt_id, read, marked, final, nxt, was in zip(
                *(b.column(x).to_pylist() for x in ("line_id", "next_id", "read", "marked", "final", "next_first", "was_marked")), strict=True
            ):
                text = countable_text(read, marked, nxt, was)
                found = (_ASCII_WORD if text.isascii() else _WORD).findall(text)
                if wanted is None or not wanted.isdisjoint(found):
                    whole = len(found) - 1 if marked and nxt and _countable(nxt) else -1
                    for k, w in enumerate(found):
                        if (w in wanted) if wanted is not None else len(w) >= 2:
                            before, behind = found[k - 1] if k else "", found[k + 1] if k + 1 < len(found) else ""
                            cut = max(len(w) - len(nxt.casefold()), 0) if k == whole else 0
                            out.append((line, nxt_id if cut else -1, w, None, cut, before, behind))
                if nxt and found and not marked and not final:
                    if known is None:
                        if may_go_on(read, found[-1]):
                            out.append((line, -1, "", None, int(is_name(read, found[-1], nxt)), found[-1], nxt.casefold()))
                    elif goes_on(read, found[-1], nxt, known):
                        out.append((line, -1, "", None, 0, "", ""))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _USE_TYPES, strict=True)], names=_USE_NAMES)

    return run


def judged_threes(threes: DataFrame, pairs: DataFrame, evidence: float = CHAR_EVIDENCE) -> DataFrame:
    """(before, word, behind, meant): _Neighbours.meant by joins, for pairs that are too many for one worker. ``threes``:
    before, word, behind, each once; ``pairs``: a, b, n.

    The key of the index is what is left of three characters without the middle one; characters between the same two
    are its candidates. Before they are joined, places at which not even the best candidate could do are left out.
    """
    listed = threes.sparkSession.createDataFrame([(x, y) for x, ys in _listed().items() for y in ys], "word string, y string")
    keys = ["before", "word", "behind"]

    def n_of(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
        return df.join(pairs.select(F.col("a").alias(a), F.col("b").alias(b), F.col("n").alias(name)), [a, b], "left").fillna(0, [name])

    def log_of(c: str) -> Column:
        return F.log(F.col(c) + 0.5)

    totals = checkpoint(pairs.groupBy("a").agg(F.sum("n").alias("total"), F.max("n").alias("most")))
    base = n_of(n_of(threes, "before", "word", "n1"), "word", "behind", "n2")
    had = F.log(F.greatest(F.col("n1") - 1, F.lit(0)) + 0.5) + F.log(F.greatest(F.col("n2") - 1, F.lit(0)) + 0.5)
    base = checkpoint(base.select(*keys, had.alias("had")))
    own = n_of(n_of(base.join(F.broadcast(listed), "word"), "before", "y", "m1"), "y", "behind", "m2")
    by_table = checkpoint(own.where(log_of("m1") + log_of("m2") - F.col("had") >= evidence).select(*keys, F.col("y").alias("meant")))
    # n(y, behind) is at most what y has in all, so that a candidate's score is at most that of its pair before, and log 1.25.
    few = 2 * (OTHER - PAIR)
    rest = (
        base.join(by_table.select(*keys).distinct(), keys, "left_anti")
        .join(totals.select(F.col("a").alias("word"), F.col("total").alias("own_total")), "word", "left")
        .join(totals.select(F.col("a").alias("before"), F.col("most").alias("best_before")), "before")
        .withColumn("own_total", F.greatest(F.coalesce("own_total", F.lit(0)), F.lit(1)))
        .where(log_of("best_before") + F.log(F.lit(1.25)) + F.log("own_total") - F.col("had") - few >= evidence - 1e-9)
    )
    candidates = (
        rest.join(pairs.select(F.col("a").alias("before"), F.col("b").alias("y"), F.col("n").alias("m1")).where(F.col("y").rlike(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}ー]")), "before")
        .join(pairs.select(F.col("a").alias("y"), F.col("b").alias("behind"), F.col("n").alias("m2")), ["y", "behind"])
        .join(totals.select(F.col("a").alias("y"), "total"), "y")
        .join(F.broadcast(listed.groupBy("word").agg(F.collect_list("y").alias("own"))), "word", "left")
        .withColumn("score", log_of("m1") + log_of("m2") - F.log("total"))
    )
    fits = (F.col("y") != F.col("word")) & ~F.coalesce(F.array_contains("own", F.col("y")), F.lit(False))
    best = candidates.groupBy(*keys, "had", "own_total").agg(F.count("*").alias("n"), F.min(F.when(fits, F.struct((-F.col("score")).alias("minus"), "y"))).alias("b"))
    enough = -F.col("b.minus") + F.log("own_total") - F.col("had") - few - F.log("n") >= evidence
    return by_table.unionByName(best.where(enough).select(*keys, F.col("b.y").alias("meant")))


def may_go_on(read: str, a: str) -> bool:
    """Whether a line ends with its last word, a (case folded), and that has no digits."""
    return not _DIGIT.search(a) and read.casefold().endswith(a)


def is_name(read: str, a: str, nxt: str) -> bool:
    """Whether a line's last word (a, case folded) and the next line's first may be the halves of a name."""
    return nxt[0].islower() and len(a) > 1 and read[-len(a)].isupper()


def goes_on(read: str, a: str, nxt: str, known: dict[str, int]) -> bool:
    """Whether a line's last word (a, case folded) and the next line's first are one word: together they are a known word
    and one of them is hardly a word by itself; or they are the halves of a rare name, a with a capital, neither of them
    ever seen inside a line."""
    if not may_go_on(read, a):
        return False
    b = nxt.casefold()
    both, alone = known.get(a + b, 0), (known.get(a, 0), known.get(b, 0))
    return (both >= 2 and 4 * min(alone) <= both) or (alone == (0, 0) and is_name(read, a, nxt))


def _word_table(counts: DataFrame) -> DataFrame:
    """(word, n, inside): inside counts the occurrences that do not begin or end a line."""

    def of(what: str) -> Column:
        return F.sum(F.when(F.col("what") == what, F.col("n")).otherwise(0))

    return (
        counts.where("what in ('w', 'e')")
        .groupBy(F.col("key").alias("word"))
        .agg(of("w").alias("n"), (of("w") - of("e")).alias("inside"))
        .where(F.col("word").rlike("\\p{L}"))
    )


def suspects(body: DataFrame, counts: DataFrame, words: DataFrame, evidence: float = CHAR_EVIDENCE) -> tuple[DataFrame, DataFrame, bool]:
    """One pass over the body: uses of words with candidates, lines that go on without a mark (word is empty), and
    characters of dense scripts that stand for others (meant is set, cut is the character's place); the candidates; and
    whether the lines that go on are decided, which needs a lexicon that all workers can hold; if not, those that may
    are here for unmarked_breaks."""
    found = checkpoint(corrections(words))
    context = body.sparkSession.sparkContext
    # Words that have candidates are few; where they aren't, all words leave Python for the join.
    asked = found.select("word").distinct()
    few = asked.limit(SENT_WORDS + 1).count() <= SENT_WORDS
    shared = context.broadcast({r["word"] for r in asked.toLocalIterator()}) if few else None
    inside = words.where("inside > 0").select("word", "inside")
    small = inside.limit(SENT_WORDS + 1).count() <= SENT_WORDS
    lexicon = context.broadcast({r["word"]: r["inside"] for r in inside.toLocalIterator()}) if small else None
    pairs = counts.where("what = 'c' and n >= 2").select("key", "n")
    sent = context.broadcast({r["key"]: r["n"] for r in pairs.toLocalIterator()}) if pairs.limit(CHAR_PAIRS + 1).count() <= CHAR_PAIRS else None
    rows = body.where("kind <> 'none'").select("line_id", "next_id", "read", "marked", "kind", "final", "next_first", "was_marked", "last_char")
    seen = written(rows.mapInArrow(_uses(shared, lexicon, sent, uuid.uuid4().hex, evidence), _USE))
    if sent is None:
        # Every dense character is here, meant being empty: those that the joins find stay.
        places = seen.where("meant = ''").drop("meant")
        two = pairs.select(F.substring("key", 1, 1).alias("a"), F.substring("key", 2, 1).alias("b"), "n")
        judged = judged_threes(places.select("before", "word", "behind").distinct(), checkpoint(two), evidence)
        found_there = places.join(bounded_broadcast(checkpoint(judged)), ["before", "word", "behind"])
        seen = checkpoint(seen.where("meant is null").unionByName(found_there.select(*seen.columns)))
    return seen, found, small


def misread_characters(seen: DataFrame) -> DataFrame:
    """(line_id, at, read, meant): characters of dense scripts that stand for others; at counts characters of the line's
    reading."""
    return seen.where("meant is not null").select("line_id", F.col("cut").alias("at"), F.col("word").alias("read"), "meant")


def misread_words(seen: DataFrame, found: DataFrame, counts: DataFrame, evidence: float = WORD_EVIDENCE) -> DataFrame:
    """(line_id, read, meant): words of spaced scripts that stand for others."""
    uses = seen.where("meant is null and word <> ''").drop("meant").join(bounded_broadcast(found), "word")
    uses = checkpoint(uses.withColumn("use", F.monotonically_increasing_id()))
    pairs = counts.where("what = 'b'").select(F.col("key").alias("pair"), F.col("n").alias("n_pair"))
    sides = uses.select(
        "use",
        "meant",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("as_meant"), F.concat_ws(" ", "before", "meant").alias("pair")),
                F.struct(F.lit(True).alias("as_meant"), F.concat_ws(" ", "meant", "behind").alias("pair")),
                F.struct(F.lit(False).alias("as_meant"), F.concat_ws(" ", "before", "word").alias("pair")),
                F.struct(F.lit(False).alias("as_meant"), F.concat_ws(" ", "word", "behind").alias("pair")),
            )
        ).alias("s"),
    ).select("use", "meant", "s.*")
    context = (
        sides.join(pairs, "pair")
        .groupBy("use", "meant")
        .agg(
            F.sum(F.when(F.col("as_meant"), F.col("n_pair")).otherwise(0)).alias("b_meant"),
            F.sum(F.when(~F.col("as_meant"), F.col("n_pair")).otherwise(0)).alias("b_word"),
        )
    )
    own = F.when(F.col("before") != "", 1).otherwise(0) + F.when(F.col("behind") != "", 1).otherwise(0)
    b_meant, b_word = F.coalesce("b_meant", F.lit(0)), F.greatest(F.coalesce("b_word", F.lit(0)) - own, F.lit(0))
    score = (
        F.log(F.col("n_meant") / F.col("n"))
        + F.log((b_meant + 1) / (b_word + 1))
        - F.col("cost") * 2
        + F.when(F.col("word").rlike("\\p{Nd}"), 2.0).otherwise(0.0)
        - F.when(F.length("word") <= 3, 1.5).otherwise(0.0)
    )
    judged = uses.join(context, ["use", "meant"], "left").withColumn("score", score).where(F.col("score") >= evidence)
    # A short word is one letter from many others: its candidate must have stood between the same neighbours.
    judged = judged.where((F.length("word") > 3) | F.col("word").rlike("\\p{Nd}") | (F.coalesce("b_meant", F.lit(0)) > 0))
    best = Window.partitionBy("line_id", "word", "cut", "before", "behind").orderBy(F.desc("score"), "meant")
    return (
        judged.withColumn("rank", F.row_number().over(best))
        .where("rank = 1")
        .select(_place("word", "meant", "cut", "line_id", "next_id").alias("line_id"), F.col("word").alias("read"), "meant")
    )


@F.pandas_udf(T.LongType())
def _place(word: pd.Series, meant: pd.Series, cut: pd.Series, line: pd.Series, nxt: pd.Series) -> pd.Series:
    """The line in which a broken word is misread: that of its first letter that differs."""
    out = []
    for w, m, k, a, b in zip(word, meant, cut, line, nxt, strict=True):
        same = next((i for i, (x, y) in enumerate(zip(w, m, strict=False)) if x != y), min(len(w), len(m)))
        out.append(a if not k or same < k else b)
    return pd.Series(out, dtype="int64")


def unmarked_breaks(seen: DataFrame, words: DataFrame) -> DataFrame:
    """line_id of lines whose last word goes on in the next line without a mark: goes_on by joins. ``seen``: of suspects,
    where before and behind are the two words, case folded, and cut tells whether they may be a name."""
    lexicon = words.where("inside > 0").select("word", F.col("inside").alias("n"))
    ends = seen.where("word = ''").select("line_id", F.col("before").alias("a"), F.col("behind").alias("b"), F.concat("before", "behind").alias("ab"), "cut")

    def known(name: str) -> DataFrame:
        return bounded_broadcast(lexicon.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}")))

    for name in ("ab", "a", "b"):
        ends = ends.join(known(name), name, "left")
    n = {name: F.coalesce(f"n_{name}", F.lit(0)) for name in ("ab", "a", "b")}
    word = (n["ab"] >= 2) & (4 * F.least(n["a"], n["b"]) <= n["ab"])
    return ends.where(word | ((n["a"] == 0) & (n["b"] == 0) & (F.col("cut") == 1))).select("line_id")


def page_noise(lines: DataFrame) -> DataFrame:
    """(line_id, noise): head, number, break and misread, one row per line and kind.

    A line sent twice counts once. Null, empty and invisible texts have no noise. Deleted lines are judged like others.
    A page's body is its result's lines in reading order, ties by line_id; lines without a result are one run of their
    page, and without a page each stands alone.
    """
    rows, counts = read_pages(lines)
    body = rows.where("not head and not number")
    words = checkpoint(_word_table(counts))
    seen, found, with_breaks = suspects(body, counts, words)
    starts = F.col("next_first").rlike(r"^\p{Nd}?[\p{L}\p{M}]")
    is_break = ~F.col("head") & ~F.col("number") & F.col("marked") & (F.col("kind") == "spaced") & starts
    flags = F.array(F.when(F.col("head"), "head"), F.when(F.col("number"), "number"), F.when(is_break, "break"))

    def of(df: DataFrame, noise: str) -> DataFrame:
        return df.select("line_id", F.lit(noise).alias("noise"))

    unmarked = seen.where("word = ''") if with_breaks else unmarked_breaks(seen, words)
    return (
        rows.where("head or number or marked")
        .select("line_id", F.explode(F.array_compact(flags)).alias("noise"))
        .unionByName(of(unmarked, "break"))
        .unionByName(of(misread_words(seen, found, counts), "misread"))
        .unionByName(of(misread_characters(seen), "misread"))
        .distinct()
    )


def _assemble(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, known = (x if x is None else x.value for x in shared)
        form = Canonical(vocabulary)
        for b in batches:
            if known is not None:
                of = [known] * len(b)
            else:
                of = [{} if c is None else {x["word"]: x["inside"] for x in c} for c in b["counted"]]
            yield pd.DataFrame({"result_id": b["result_id"], "text": [assembled(list(x), c, form) for x, c in zip(b["lines"], of, strict=True)]})

    return run


def _asked(shared):
    """(result_id, word): the words whose counts a page can ask for while it is put together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form = Canonical(shared.value)
        for b in batches:
            out = []
            for result, lines in zip(b["result_id"], b["lines"], strict=True):
                asked: set[str] = set()
                assembled(list(lines), {}, form, asked)
                out += [(result, w) for w in asked]
            yield pd.DataFrame(out, columns=["result_id", "word"])

    return run


def _items(array) -> list:
    """A nested array as a list; pandas hands it over as an array, which has no truth value, or as None."""
    return [] if array is None else list(array)


def assembled(lines: list[dict], known: dict[str, int], form: Canonical, asked: set[str] | None = None) -> str:
    """Paragraphs of a page's body lines (text, broken, words and characters to repair), parted by line breaks.

    A word broken at a line's end is put together, without its mark if the whole is a known word or one of its parts is
    none; a compound keeps its hyphen. A paragraph ends where a short line ends with a final mark.

    ``asked`` (with nothing known, so that no hyphen is kept) takes the words whose counts decide, whichever hyphens are.
    """
    out, fixes, joins = "", {}, []
    widths = [len(x["text"]) for x in lines]
    full = max(widths, default=0)
    joined = ""
    for x, width in zip(lines, widths, strict=True):
        text = form(x["text"], x.get("rest")) or ""
        for c in _items(x["chars"]):
            if c["cut"] < len(text) and text[c["cut"]] == c["word"]:
                text = text[: c["cut"]] + c["meant"] + text[c["cut"] + 1 :]
        fixes.update((w["read"], (w["meant"], w["spelling"])) for w in _items(x["words"]))
        if out and not joined and x["kind"] != "dense":
            out += "" if out.endswith(("\n", " ")) else " "
        if joined == "mark":
            a, b = _WORD.findall(out)[-1:], _WORD.match(text)
            ends = [reading(w).casefold() for w in (*a, b.group() if b else "")]
            if asked is not None and a:
                # Where a hyphen is kept before, the last word begins behind it.
                *_, last = _WORD.finditer(out)
                for at in (last.start(), *(p for p in joins if last.start() < p < last.end())):
                    part = reading(out[at : last.end()]).casefold()
                    asked.update((part, ends[-1], part + ends[-1]))
            joins.append(len(out))
            if len(ends) == 2 and known.get("".join(ends), 0) < 2 and all(known.get(w, 0) >= 2 for w in ends):
                out += "-"
        out += text
        joined = ""
        if x["broken"]:
            joined = "none"
            if x["marked"]:
                out, joined = regex.sub(r"[-\u2010\u2011\u2012=\u00ac\u00ad]\s*$", "", out), "mark"
        elif x["final"] and width < 0.8 * full:
            out += "\n"

    def repair(m) -> str:
        word = m.group()
        meant, rest = fixes.get(reading(word).casefold(), (None, None))
        if meant is None:
            return word
        spelled = form.trie.canonical(meant) or rest or meant
        return spelled[:1].upper() + spelled[1:] if word[:1].isupper() else spelled

    return _WORD.sub(repair, out.strip()) if fixes else out.strip()


def repaired_pages(lines: DataFrame) -> DataFrame:
    """(result_id, text): the body of each run as continuous paragraphs, parted by line breaks, in canonical spellings.

    Titles and numbers are gone, broken words whole, misread words and characters repaired. Runs without body lines, and
    lines without a result, are left out. A page is one row, and is put together in one task.
    """
    rows, counts = read_pages(lines)
    body = rows.where("not head and not number")
    words = checkpoint(_word_table(counts))
    seen, found, with_breaks = suspects(body, counts, words)
    unmarked = (seen.where("word = ''") if with_breaks else unmarked_breaks(seen, words)).select("line_id").distinct()
    vocabulary, rest = canonical_vocabulary(lines.select("text"), VOCABULARY_WORDS)
    fixed = misread_words(seen, found, counts)
    spelled = F.lit(None).cast("string").alias("spelling")
    if rest is not None:
        fixed = fixed.join(rest.select(F.col("as_read").alias("meant"), "spelling").distinct(), "meant", "left")
        spelled = F.col("spelling")
    fixed = fixed.groupBy("line_id").agg(F.collect_set(F.struct("read", "meant", spelled)).alias("words"))
    chars = seen.where("meant is not null").groupBy("line_id").agg(F.collect_set(F.struct("cut", "word", "meant")).alias("chars"))
    starts = F.col("next_first").rlike(r"^\p{Nd}?[\p{L}\p{M}]")
    parts = (
        body.select("line_id", "marked", "final", "kind", (F.col("marked") & (F.col("kind") == "spaced") & starts).alias("at_mark"))
        .join(unmarked.withColumn("goes_on", F.lit(True)), "line_id", "left")
        .join(fixed, "line_id", "left")
        .join(chars, "line_id", "left")
        .withColumn("broken", F.coalesce("at_mark", F.lit(False)) | F.coalesce("goes_on", F.lit(False)))
    )
    texts = lines.where("result_id is not null").select("line_id", "result_id", "reading_order", "text").dropDuplicates(["line_id"])
    texts = with_rest(texts, rest)
    one = F.struct("reading_order", "line_id", "text", "rest", "marked", "final", "kind", "broken", "words", "chars")
    pages = texts.join(parts, "line_id").groupBy("result_id").agg(F.array_sort(F.collect_list(one)).alias("lines"))
    context = lines.sparkSession.sparkContext
    inside = words.where("inside > 0").select("word", "inside")
    shared, result = context.broadcast(vocabulary), "result_id long, text string"
    if inside.limit(SENT_WORDS + 1).count() <= SENT_WORDS:
        lexicon = context.broadcast({r["word"]: r["inside"] for r in inside.toLocalIterator()})
        return by_key(pages, "result_id").mapInPandas(_assemble((shared, lexicon)), result)
    # A lexicon too large for that: pages are read once more, for the words that they ask for, whose counts are joined.
    pages = written(pages)
    asked = by_key(pages, "result_id").mapInPandas(_asked(shared), "result_id long, word string")
    counted = asked.join(inside, "word").groupBy("result_id").agg(F.collect_list(F.struct("word", "inside")).alias("counted"))
    return by_key(pages.join(counted, "result_id", "left"), "result_id").mapInPandas(_assemble((shared, None)), result)
