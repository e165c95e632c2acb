"""Sentences of pages in many languages and scripts.

Method: a pushdown automaton reads a page from mark to mark. Its stack holds open quotation marks and brackets; a second
one over the heads of lines holds the levels of lists, whose items are sentences of their own. A trie of abbreviations,
read backwards from a point, and the terminators of each script decide where a sentence ends while no mark is open. It
emits offsets into the text as it is; running titles and page numbers are passed over.

Opening marks that nothing closes are ordinary characters (see paired). Thai sentences are parted by spaces, unmarked
classical Chinese ones by their closing particles.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.reading import reading, table
from foliospark.llm.scans import is_number, is_title, may_be_title, title_key, titles_of_lines
from foliospark.session import bounded_broadcast, by_key, checkpoint

# Marks that may end a sentence, by script; ○ does so behind a Han character.
TERMINATORS = frozenset("!?！？。．｡।॥؟۔።։‼⁇⁈⁉")
# Opening marks and what closes them.
PAIRS = {
    "“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "〔": "〕",
    "(": ")", "（": "）", "[": "]", "［": "］", "｢": "｣", "﹁": "﹂", "﹃": "﹄",
}
CLOSERS = frozenset("".join(PAIRS.values()) + "\"'") - {"“"}
BRACKETS = frozenset("(（[［〔【")
# Abbreviations that never end a sentence before a capital letter.
ABBREVIATIONS = """
St No Nos Nr vol vols Vol Vols p pp pl pls fol fols Fig Figs fig figs cf ca viz Mr Mrs Ms Dr Prof Rev Hon Capt Col Gen Lt Sgt Maj Cpl Adm Gov Jr sen ed eds ch chap
sec Sec bk Bk pt Pt app Abb Bd Bde S Taf Kap vgl Vgl bzw z d Hr Fr Hrn sog env ex M MM Mme Mlle Mgr av apr art liv
рис Рис см См с стр т тт гл г гг им кн изд ср табл чл डॉ पृ चि श्री सं
"""
# Abbreviations that end a sentence if a capital letter or an opening mark follows.
FINAL_ABBREVIATIONS = "etc usw usf д п др ff lb lbs ft in oz cm mm km kg m i.e e.g"
# Months before which a number with a point is a day.
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner"
# Particles that end a sentence of old Chinese where no marks are written, if 者 does not follow.
PARTICLES = frozenset("也焉耳矣哉乎")
# What goes on behind a quotation in scripts without capitals.
GOES_ON = ("と", "って", "और", "पर ", "तो ")
_GOES_ON_MARKS = frozenset(",，、;；:：—–-")

_HAN = regex.compile(r"\p{Han}")
_THAI = regex.compile(r"\p{Thai}")
_HIRAGANA = regex.compile(r"\p{Hiragana}")
_MARKS = regex.compile("[。！？○．｡]")
_ROMAN = regex.compile(r"[IVXLCDM]+$")


_BLANK = " \t\r\x0b\x0c\x85\xa0\u2007\u2009\u202f\u2028\u2029"


class AbbreviationTrie:
    """Abbreviations by their letters from the last to the first, as they read; a leaf says whether one may be final."""

    def __init__(self, plain: str, final: str):
        self.root: dict = {}
        for words, may_end in ((plain, False), (final, True)):
            for word in words.split():
                node = self.root
                for c in reversed(reading(word)):
                    node = node.setdefault(c, {})
                node[""] = may_end

    def before(self, word: str) -> bool | None:
        """Of a whole word before a point: None if it is no abbreviation, else whether it may end a sentence."""
        node = self.root
        for c in reversed(word):
            node = node.get(c)
            if node is None:
                return None
        return node.get("")


_ABBREVIATED = AbbreviationTrie(ABBREVIATIONS, FINAL_ABBREVIATIONS)
_MONTHS = frozenset(MONTHS.split())


def _is_month(word: str) -> bool:
    if word in _MONTHS:
        return True
    return len(word) >= 3 and any(len(m) == len(word) and sum(x != y for x, y in zip(m, word, strict=True)) == 1 for m in _MONTHS)


_UNSEEN_CHARS = frozenset(chr(code) for code, read in table().items() if read is None)
_UNSEEN = re.compile("[" + re.escape("".join(sorted(_UNSEEN_CHARS))) + "]+")
#: White space but the ideographic space, which stands for a mark in old Chinese.
_SPACE = re.compile(r"[^\S\u3000]")


class _Page:
    """The visible body characters of a page, with their places in the text."""

    def __init__(self, text: str, titles: list[str]):
        self.text = text
        # White space at a line's end says nothing; that of old Chinese, which stands for a mark, does.
        lines = text.split("\n")
        parts: list[str] = []
        self.firsts: list[int] = []  # of each stretch that lies in the text as it is: its place in the body
        self.places: list[int] = []  # and in the text
        keys = [reading(x) for x in lines]
        longest = max((len(t) for t in titles), default=0)
        longest += longest // 5 + 1
        filled = [k for k, x in enumerate(keys) if x]
        numbers = {k for k in filled if is_number(keys[k])}
        begin = n = 0
        for k, line in enumerate(lines):
            read = keys[k]
            edge = bool(filled) and not read[:1].islower() and (k in (filled[0], filled[-1]) or k - 1 in numbers or k + 1 in numbers)
            # Lines with more letters than a title and its number are body; few lines are left to be compared.
            if not (k in numbers or (titles and may_be_title(read, longest) and is_title(title_key(read), titles, edge, False))):
                kept = line.rstrip(_BLANK)
                at = 0
                # Few lines have any, and the set knows sooner.
                for m in (*(() if _UNSEEN_CHARS.isdisjoint(kept) else _UNSEEN.finditer(kept)), None):
                    piece = kept[at : m.start() if m else None]
                    if piece:
                        self.firsts.append(n), self.places.append(begin + at), parts.append(_SPACE.sub(" ", piece))
                        n += len(piece)
                    at = m.end() if m else 0
                self.firsts.append(n), self.places.append(begin + len(line)), parts.append("\n")
                n += 1
            begin += len(line) + 1
        self.body = "".join(parts)

    def end(self, k: int) -> int:
        """The offset behind visible character k and whatever is attached to it and can't be seen."""
        at = bisect_right(self.firsts, k) - 1
        i = self.places[at] + k - self.firsts[at] + 1
        while i < len(self.text) and self.text[i] in _UNSEEN_CHARS:
            i += 1
        return i


#: Marks at the head of a list's item: a number or letter with a point or a bracket, alone or in brackets, or a bullet.
_ITEM = re.compile(r"[ \u3000]*(?:(\()?(\d{1,2}|[a-z]|[ivx]{1,5})([.)])|([•‣◦▪–—*-]))[ \u3000]+(?=\S)")
_ROMAN_ITEMS = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv".split()


def list_items(body: str) -> dict[int, tuple[int, int]]:
    """Where items of lists begin, with the end of their mark and their level. A pushdown automaton over the lines: its
    stack holds the style and the count of each open list. A mark that is the first of its style (1, a, i, a bullet) opens
    a list within the one before; the next of a style on the stack goes on with that list and closes those within it.
    Lists of one item are none, so that a line that happens to begin like one changes nothing."""
    stack: list[list] = []  # style, items so far, their places
    lists: list[list] = []
    begin = 0
    for line in body.split("\n"):
        m = _ITEM.match(line)
        if m:
            bracket, label, close, bullet = m.groups()
            readings = [("bullet" + bullet, None)] if bullet else []
            if label and not (bracket and close == "."):
                form = (bracket or "") + close
                if label.isdigit():
                    readings.append(("number" + form, int(label)))
                else:
                    readings += [("roman" + form, _ROMAN_ITEMS.index(label) + 1)] if label in _ROMAN_ITEMS else []
                    readings += [("letter" + form, ord(label) - 96)] if len(label) == 1 else []
            place = (begin + m.start() + len(m.group()) - len(m.group().lstrip()), begin + m.end())
            for depth in range(len(stack) - 1, -1, -1):
                top = stack[depth]
                if any(style == top[0] and (no is None or no == top[1] + 1) for style, no in readings):
                    del stack[depth + 1 :]
                    top[1] += 1
                    top[2].append((*place, depth))
                    break
            else:
                for style, no in readings:
                    if no in (None, 1):
                        stack.append([style, 1, [(*place, len(stack))]])
                        lists.append(stack[-1])
                        break
        begin += len(line) + 1
    return {first: (end, level) for _, n, places in lists if n > 1 for first, end, level in places}


def paired(body: str) -> set[int]:
    """The places of opening marks that are closed. A closing mark closes the nearest opening mark that it fits; those
    between are unclosed, as recognition loses marks, and ordinary characters. So are those that nothing closes, unless
    the page breaks off in the middle of a sentence: the mark that closes the last of them may stand on the next page."""
    stack: list[int] = []
    out: set[int] = set()
    for m in _BRACES.finditer(body):
        c, k = m.group(), m.start()
        fits = next((d for d in range(len(stack) - 1, -1, -1) if c in PAIRS[body[stack[d]]]), None)
        if fits is not None:
            out.add(stack[fits])
            del stack[fits:]
        elif c in PAIRS:
            stack.append(k)
    tail = body.rstrip()[-1:]
    if stack and not (tail in TERMINATORS or tail in CLOSERS or tail == "."):
        out.add(stack[-1])
    return out


_BRACES = re.compile("[" + "".join(map(re.escape, sorted(set("".join(PAIRS) + "".join(PAIRS.values()))))) + "]")
_EVENTS = "".join(map(re.escape, sorted(TERMINATORS | set("".join(PAIRS) + "".join(PAIRS.values())) | set(".○"))))
_EVENT, _EVENT_HAN, _EVENT_THAI = (re.compile(f"[{_EVENTS}{more}]") for more in ("", "\u3000" + "".join(sorted(PARTICLES)), r"\s\u3000"))
_NOT_BLANK = re.compile(r"[^ \n\u3000]")


def sentence_ends(text: str, titles: list[str]) -> list[int]:
    """Offsets of the ends of sentences; ``titles``: keys of the source's running titles.

    The automaton goes from one mark to the next; its stack holds what closes the open quotation marks and brackets, and
    while it is empty marks may end sentences. Items of lists begin sentences of their own."""
    page = _Page(text, titles)
    s = page.body
    n = len(s)
    han, thai = len(_HAN.findall(s)), len(_THAI.findall(s))
    unmarked_han = han > 0.5 * max(1, n - s.count("\n")) and not _MARKS.search(s)
    is_thai = thai > 0.3 * max(1, n)
    opening, items = paired(s), list_items(s)
    ends: list[int] = []
    stack: list[tuple[str, bool]] = []  # what closes it, and whether it opened its sentence
    start = 0  # where the last sentence ended

    def after(k: int) -> int:
        """The next character behind k that is no white space."""
        m = _NOT_BLANK.search(s, k + 1)
        return m.start() if m else n

    def last_before(k: int) -> int:
        """The last character before k that is no white space, in this sentence; -1 if there is none."""
        return start + len(s[start:k].rstrip(" \n\u3000")) - 1 if s[start:k].strip(" \n\u3000") else -1

    def word_at(k: int) -> str:
        i = k
        while i < n and (s[i].isalpha() or unicodedata.category(s[i]).startswith("M")):
            i += 1
        return reading(s[k:i])

    def word_before(k: int) -> str:
        i = k
        while i > 0 and (s[i - 1].isalnum() or unicodedata.category(s[i - 1]).startswith("M") or (s[i - 1] == "." and i > 1 and s[i - 2].isalpha() and s[i].isalpha())):
            i -= 1
        return reading(s[i:k])

    def stop(k: int) -> int:
        """Ends the sentence with visible character k and the closing marks that follow; gives the next place."""
        nonlocal start
        while k + 1 < n and s[k + 1] in CLOSERS and not (s[k + 1] in "\"'" and k + 2 < n and s[k + 2].isalnum()):
            k += 1
        ends.append(page.end(k))
        start = k + 1
        return k + 1

    def marked(k: int) -> bool:
        """Whether what stands before a closing mark, other closing marks left aside, is a final mark."""
        k -= 1
        while k >= start and (s[k] in CLOSERS or s[k] in " \n\u3000"):
            k -= 1
        return k >= start and (s[k] in TERMINATORS or s[k] == "." or (s[k] == "○" and bool(_HAN.match(s[k - 1 : k]))))

    def number_first(k: int) -> bool:
        """Whether the sentence has but a number so far."""
        said = s[start:k].strip(" \n\u3000")
        return not any(c.isalpha() for c in said) and all(c.isalnum() or c in ". \n\u3000" for c in said[1:])

    def point_ends(k: int) -> bool:
        """Whether the point at k ends a sentence."""
        if k + 1 < n and s[k + 1] not in " \n" and s[k + 1] not in CLOSERS:
            return False
        if (k + 1 < n and s[k + 1] == ".") or (k and s[k - 1] == "."):
            return False
        j = k + 1
        while j < n and s[j] in CLOSERS:
            j += 1
        j = after(j - 1)
        if j >= n:
            return True
        nxt, word = s[j], word_before(k)
        if nxt in _GOES_ON_MARKS or nxt.islower() or nxt.isdigit():
            return j in items
        following = word_at(j)
        if word.isdigit():
            return not (_is_month(following) or number_first(k))
        if len(word) == 1 and word.isupper() and word.isalpha():
            return False
        final = _ABBREVIATED.before(word)
        if final is not None:
            return final
        # A roman number goes on with what a misread abbreviation began.
        behind = s[j + len(following)] if j + len(following) < n else ""
        return not (_ROMAN.match(following) and behind in ",;)" and len(word) <= 4 and behind != "")

    def thai_ends(j: int, last: int) -> bool:
        """Whether the white space between two Thai letters ends a sentence: spaces part sentences and what is counted, not
        words; a line break alone ends none."""
        there = j < n and last >= 0 and _THAI.match(s[j]) and _THAI.match(s[last]) and not s[last].isdigit() and not s[j].isdigit()
        return bool(there and s[last + 1 : j].strip("\n"))

    event = (_EVENT_HAN if unmarked_han else _EVENT_THAI if is_thai else _EVENT).search
    heads = sorted(items)
    k = 0
    while True:
        m = event(s, k)
        at = m.start() if m else n
        if heads and heads[0] <= at:
            # An item begins: what stands before it ends, and its mark is no end. An open bracket or quotation goes on.
            head = heads.pop(0)
            if head >= k:
                if not stack and (last := last_before(head)) >= 0:
                    stop(last)
                k = items[head][0]
            continue
        if m is None:
            break
        k, c = at, m.group()
        if c == "\u3000" or c.isspace():
            if not stack:
                last = last_before(k)
                if last >= 0 and ((unmarked_han and c == "\u3000") or (is_thai and thai_ends(after(k - 1), last))):
                    k = max(k, stop(last))
                    continue
            k += 1
            continue
        if stack and c in stack[-1][0]:
            _, opened_it = stack.pop()
            bracket = c in ")）]］〕】"
            if not stack and marked(k):
                j = after(k)
                goes_on = j < n and (
                    s[j] in _GOES_ON_MARKS
                    or s[j] in TERMINATORS
                    or s[j] == "."
                    or s[j].islower()
                    or (not bracket and bool(_HIRAGANA.match(s[j])))
                    or s.startswith(GOES_ON, j)
                )
                if (not bracket or opened_it) and not goes_on:
                    k = stop(k)
                    continue
        elif k in opening:
            stack.append((PAIRS[c], last_before(k) < 0))
        elif stack:
            pass
        elif c in TERMINATORS or (c == "○" and k and _HAN.match(s[k - 1] if s[k - 1] != "\n" else s[max(0, k - 2)])):
            j = after(k)
            if not (c in "!?！？" and j < n and s[j] in ",，、"):
                k = stop(k)
                continue
        elif c == ".":
            if point_ends(k):
                k = stop(k)
                continue
        elif unmarked_han and c in PARTICLES:
            j = after(k)
            if j >= n or s[j] != "者":
                k = stop(k)
                continue
        k += 1
    if (last := last_before(n)) >= 0 and (not ends or page.end(last) > ends[-1]):
        ends.append(page.end(last))
    return ends


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids, nos, starts, ends = [], [], [], []
        for result, text, titles in zip(b["result_id"], b["raw_text"], b["titles"], strict=True):
            at = 0
            for no, end in enumerate(sentence_ends(text, [] if titles is None else list(titles))):
                while at < end and (text[at].isspace() or text[at] in _UNSEEN_CHARS):
                    at += 1
                ids.append(result), nos.append(no), starts.append(at), ends.append(end)
                at = end
        yield pd.DataFrame({"result_id": ids, "no": nos, "start_char": starts, "end_char": ends}).astype({"result_id": "int64", "no": "int32", "start_char": "int64", "end_char": "int64"})


def sentences(results: DataFrame) -> DataFrame:
    """(result_id, no, start_char, end_char) of each sentence of raw_text, in code points, end_char exclusive.

    Null, empty and blank texts have none. A row sent twice counts once. Titles are found over all pages of a source.
    A sentence in which a title or page number stands goes on behind it, so that its span holds the title, too.
    """
    pages = checkpoint(
        by_key(
            results.where("result_id is not null and length(trim(raw_text)) > 0").select("result_id", "source_id", "page_id", "raw_text"),
            "result_id",
        ).dropDuplicates(["result_id"])
    )
    lines = pages.select("source_id", "page_id", F.explode(F.split("raw_text", "\n")).alias("text"))
    titles = bounded_broadcast(checkpoint(titles_of_lines(lines)))
    return (
        pages.join(titles, "source_id", "left")
        .select("result_id", "raw_text", "titles")
        .mapInPandas(_split, "result_id long, no int, start_char long, end_char long")
    )
