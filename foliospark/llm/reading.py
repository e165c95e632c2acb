"""One form for texts that look the same and differ in their characters.

Method: words of the corpus go into a trie by their spelling. A token is walked through it by a weighted edit automaton:
look-alikes, width, composition and ignorable characters cost nothing; a letter of another alphabet that no table lists,
within a word, costs FOREIGN whatever it stands for; anything else costs one. Within the budget, what costs least is
reached, and of that the most frequent spelling is the canonical one, so that a look-alike that nobody has listed is
brought to the word that it disguises. Tokens that reach no spelling are brought to one form by table. Texts are
compared by what their canonical forms read as.
"""

from __future__ import annotations

import gc
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.operators.skew import HOT_ROWS, PARTS
from foliospark.session import bounded_broadcast, checkpoint, spread

# Letters of other alphabets and the Latin letters that they look like.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    # Greek
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "υ": "u", "γ": "y", "κ": "k", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ϲ": "c", "ϳ": "j",
    # Armenian and Latin letters of their own
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ı": "i", "ɑ": "a", "ɡ": "g", "ꞵ": "ß", "β": "ß",
}

# Hyphens, quotation marks and other signs by the sign that they look like.
SIGNS = {
    "‐": "-", "‑": "-", "‒": "-", "−": "-", "﹣": "-", "⁃": "-", "’": "'", "‘": "'", "ʼ": "'", "′": "'", "＇": "'",
    "·": "·", "・": "·", "‧": "·", "•": "·", "⸱": "·",
}

# Radicals that Unicode gives no compatibility character, and the characters that they look like.
RADICALS = {
    "⺁": "厂", "⺅": "亻", "⺋": "卩", "⺌": "小", "⺗": "心", "⺟": "母", "⺠": "民", "⺡": "氵", "⺣": "灬", "⺤": "爪", "⺦": "丬",
    "⺨": "犭", "⺩": "王", "⺬": "示", "⺭": "礻", "⺮": "竹", "⺯": "糸", "⺰": "纟", "⺶": "羊", "⺷": "羊", "⺼": "月", "⻁": "虎",
    "⻂": "衤", "⻄": "西", "⻅": "见", "⻆": "角", "⻈": "讠", "⻉": "贝", "⻋": "车", "⻌": "辶", "⻎": "辶", "⻏": "阝", "⻐": "钅",
    "⻑": "長", "⻒": "長", "⻓": "长", "⻔": "门", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞",
    "⻝": "食", "⻟": "飠", "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄",
    "⻪": "黾", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻲": "龜", "⻳": "龟",
}

#: Compatibility mappings that keep the reading; raised, lowered and circled characters and fractions change it.
SAME_READING = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")

#: Marks that are invisible though they are no format characters: variation selectors, fillers and joiners.
INVISIBLE = {*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), 0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0}

#: Words whose spellings go to all workers; those beyond get their canonical spelling by a join on their reading.
VOCABULARY_WORDS = 50_000

#: What an unlisted letter of another alphabet costs, and what a token may cost: one such letter, no other edit.
FOREIGN, BUDGET = 0.4, 0.5
#: Stands for such a letter in the patterns that words beyond the vocabulary are sought by.
WILD = "\x01"


@lru_cache(maxsize=1)
def table() -> dict[int, str | None]:
    """Character (after canonical decomposition) to what it reads as; none for what can't be seen."""
    out: dict[int, str | None] = {}
    # Ideographs have canonical mappings only, which decomposition applies before this table.
    for code in (*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0xE0000, 0xE0200)):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cs" or kind == "Cn":
            continue
        if kind == "Cf" or code in INVISIBLE:
            out[code] = None
        elif kind == "Zs":
            out[code] = " "
        elif (to := unicodedata.decomposition(c)).startswith(SAME_READING):
            text = unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in to.split()[1:]))
            if text != c:
                out[code] = text
    for c, to in (LOOK_ALIKES | SIGNS | RADICALS).items():
        out[ord(c)] = to
    # What a mapping gives may map again: a wide letter, a compatibility form of a radical.
    for code, to in list(out.items()):
        if to and any(ord(x) in out and out[ord(x)] != x for x in to):
            out[code] = "".join(out.get(ord(x), x) or "" for x in to)
    return out


#: Thai: two single vowels for the double one, and the order of a ring before a tone mark.
_THAI = [("เเ", "แ"), *[("ํ" + tone, tone + "ํ") for tone in "่้๊๋"]]


#: Characters that read as themselves wherever they stand in a composed text, and the others, as met.
_CLEAN: set[str] = set(map(chr, range(128)))
_OTHER: set[str] = set("\u0e40\u0e4d")  # these two change with their neighbours


def _reads_as_it_is(text: str) -> bool:
    """Whether a text is composed and made of characters that read as themselves, so that nothing has to be mapped."""
    if not _CLEAN.issuperset(text):
        for c in set(text) - _CLEAN:
            if c in _OTHER:
                return False
            apart = unicodedata.normalize("NFD", c)
            # A character that begins no composition with those before it, stays whole and is not in the table.
            same = unicodedata.combining(c) == 0 and not unicodedata.category(c).startswith("M") and not "\u1160" <= c <= "\u11ff"
            if same and unicodedata.normalize("NFC", apart) == c and apart.translate(table()) == apart:
                _CLEAN.add(c)
            else:
                _OTHER.add(c)
                return False
    return True


def reading(text: str | None) -> str | None:
    """The form that texts share that read the same. Null stays null."""
    if text is None:
        return None
    if text.isascii() or _reads_as_it_is(text):
        out = text
    else:
        out = unicodedata.normalize("NFD", text).translate(table())
        for a, b in _THAI:
            if a in out:
                out = out.replace(a, b)
        out = unicodedata.normalize("NFC", out)
    return " ".join(out.split())


class Trie:
    """Spellings by their characters.

    A node is [edges by the first character that they read as, edges that can't be seen, spelling, weight]; an edge is
    what it reads as and the node behind it.
    """

    def __init__(self, words: dict[str, int]):
        # The collector would look at the growing trie again and again, though nothing in it can be freed.
        collects = gc.isenabled()
        gc.disable()
        try:
            self._build(words)
        finally:
            if collects:
                gc.freeze()
                gc.enable()

    def _build(self, words: dict[str, int]) -> None:
        self.root, map_ = [{}, [], None, -1], table()
        by_letter: dict[int, dict[str, list]] = {}
        for word, weight in words.items():
            node = self.root
            for c in word if word.isascii() else unicodedata.normalize("NFD", word):
                own = by_letter.setdefault(id(node), {})
                if c not in own:
                    own[c] = child = [{}, [], None, -1]
                    if as_read := map_.get(ord(c), c):
                        node[0].setdefault(as_read[0], []).append((as_read, child))
                    else:
                        node[1].append(child)
                node = own[c]
            if weight > node[3]:
                node[2:] = [word, weight]

    def canonical(self, read: str, foreign: frozenset[int] = frozenset()) -> str | None:
        """The heaviest of the cheapest spellings that the automaton reaches for a token that reads so; ties: the least one.
        ``foreign``: the places of unlisted letters of other alphabets in it.

        A state is a node, the place in the reading and what it has cost. The automaton follows edges that read as what
        comes next, passes those that can't be seen, and at a foreign letter follows every edge of one letter, its own too,
        at FOREIGN's cost. Any other edit would cost one, which the budget does not have.
        """
        states, best = [(self.root, 0, 0.0)], None
        while states:
            node, at, cost = states.pop()
            if at == len(read):
                if node[2] is not None and (best is None or (cost, -node[3], node[2]) < best):
                    best = (cost, -node[3], node[2])
            elif at in foreign:
                if cost + FOREIGN <= BUDGET:
                    states += [(child, at + 1, cost + FOREIGN) for edges in node[0].values() for as_read, child in edges if len(as_read) == 1]
            else:
                states += [(child, at + len(as_read), cost) for as_read, child in node[0].get(read[at], ()) if read.startswith(as_read, at)]
            states += [(child, at, cost) for child in node[1]]
        return best[2] if best else None


#: Letters that look-alikes are known for.
_LISTED = frozenset(LOOK_ALIKES) | frozenset(LOOK_ALIKES.values())


@lru_cache(maxsize=10_000)
def _alphabet(c: str) -> str:
    """The alphabet of a letter by its name; empty for what is none."""
    return unicodedata.name(c, "").split(" ")[0] if unicodedata.category(c).startswith("L") else ""


@lru_cache(maxsize=10_000)
def _alphabets(c: str) -> frozenset[str]:
    """The alphabets in which a letter may stand: its own, and those of its known look-alikes."""
    if not (own := _alphabet(c)):
        return frozenset()
    same = {x for a, b in LOOK_ALIKES.items() if c in (a, b) for x in (a, b)}
    return frozenset({own} | {_alphabet(x) for x in same})


def foreign_letters(token: str) -> frozenset[int]:
    """The place, in what a token reads as, of its one letter that no table lists and that is of another alphabet than the
    rest, which has two letters or more of a common alphabet; empty for any other token."""
    apart = unicodedata.normalize("NFD", token)
    of = [x for c in apart if (x := _alphabets(c))]
    if len(of) < 3 or frozenset.intersection(*of):
        return frozenset()
    map_, at, out = table(), 0, []
    for c in apart:
        to = map_.get(ord(c), c)
        if to == c and c not in _LISTED and (own := _alphabets(c)):
            rest = list(of)
            rest.remove(own)
            if (common := frozenset.intersection(*rest)) and not common & own:
                out.append(at)
        at += len(to or "")
    return frozenset(out) if len(out) == 1 else frozenset()


#: Words of scripts that look like one another, with the marks and invisible characters in them, and all that is between.
_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Devanagari", "Armenian", "Cherokee", "Coptic", "Lisu", "Georgian")
_IN = "".join(rf"\p{{{x}}}" for x in (*_SCRIPTS, "M", "Cf"))
_TOKEN = regex.compile(rf"[{_IN}]+|[^{_IN}]+")


def _words_of(text: str) -> Column:
    """The words of a column, as _TOKEN finds them."""
    return F.regexp_extract_all(text, F.lit("([" + "".join(rf"\p{{Is{x}}}" for x in _SCRIPTS) + r"\p{M}\p{Cf}]+)"), F.lit(1))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of the column ``text``: spellings as they are."""
    return texts.select(F.explode(_words_of("text")).alias("word")).groupBy("word").count().withColumnRenamed("count", "n")


def _as_read(token: str) -> str:
    """What a token reads as, by table, decomposed: tokens that share it read the same."""
    whole = unicodedata.normalize("NFD", token).translate(table())
    for a, b in _THAI:
        whole = whole.replace(a, b)
    return whole


class Canonical:
    """Brings texts to canonical spellings; remembers tokens."""

    def __init__(self, words: list[tuple[str, int]]):
        self.trie, self.known = Trie(dict(words)), {}

    def _token(self, t: str, rest: dict[str, str]) -> str:
        to = self.known.get(t)
        if to is None:
            if len(self.known) >= 100_000:
                self.known.clear()
            whole = _as_read(t)
            foreign = frozenset() if t.isascii() else foreign_letters(t)
            to = self.trie.canonical(whole, foreign) if whole[:1].isalpha() else None
            if to is None or (foreign and to == t):
                to = rest.get(t, to)
            self.known[t] = to = unicodedata.normalize("NFC", whole) if to is None else to
        return to

    def __call__(self, text: str | None, rest: list | None = None) -> str | None:
        """``rest``: word and spelling of the text's words beyond the vocabulary, as with_rest gives them."""
        if text is None:
            return None
        more = {x["word"]: x["spelling"] for x in rest} if rest is not None else {}
        return " ".join("".join([self._token(t, more) for t in _TOKEN.findall(text)]).split())


#: The last vocabulary's forms, kept by a Python worker from one task to the next.
_made: dict[str, Canonical] = {}


def canonical_vocabulary(texts: DataFrame, words: int = VOCABULARY_WORDS, whole: bool = True) -> tuple[list[tuple[str, int]], DataFrame | None]:
    """The most frequent spellings of the column ``text``, at most ``words``, a bounded list for the driver; and for the
    words beyond, (word, as_read, spelling) where the most frequent spelling that reads so differs from the table's form,
    or, for a word with a foreign letter, of the words beyond that it may stand for (None if there are none). Not
    ``whole``: those with a foreign letter alone, for callers that use only the reading, which other spellings don't
    change."""
    counts = checkpoint(word_counts(texts))
    top = counts.orderBy(F.desc("n"), "word").limit(words + 1).collect()
    vocabulary = [(r["word"], r["n"]) for r in top[:words]]
    if len(top) <= words:
        return vocabulary, None
    # The list holds the spellings in this very order: whatever comes behind its last one is beyond.
    word, n = vocabulary[-1] if vocabulary else ("", 1 << 62)

    def beyond(count: str, name: str) -> Column:
        return (F.col(count) < n) | ((F.col(count) == n) & (F.col(name) > word))

    read = counts.withColumns({"as_read": _read_udf("word"), "pattern": _pattern_udf("word")}).where("as_read is not null")
    read = checkpoint(read if whole else read.where(F.col("pattern").isNotNull() | beyond("n", "word")))
    # Words with a foreign letter go by the words beyond that differ from them in that letter alone.
    odd = checkpoint(read.where("pattern is not null").select("word", "as_read", "pattern"))
    rest = None
    if not odd.isEmpty():
        size = F.length("as_read")
        patterns = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring("as_read", F.lit(1), i - 1), F.lit(WILD), F.substring("as_read", i + 1, size)))
        spelled = read.where(beyond("n", "word") & F.col("pattern").isNull()).select("word", "n", F.explode(patterns).alias("pattern"))
        wanted = bounded_broadcast(odd.select("pattern").distinct())
        best = spelled.join(wanted, "pattern", "left_semi").groupBy("pattern").agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col("word").alias("spelling"))).alias("b"))
        rest = odd.join(best, "pattern").select("word", "as_read", "b.spelling")
    if whole:
        best = read.groupBy("as_read").agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col("word").alias("spelling"))).alias("b"))
        # A reading is beyond if even its most frequent spelling is.
        best = best.select("as_read", (-F.col("b.minus")).alias("n"), "b.spelling").where(beyond("n", "spelling") & (F.col("spelling") != F.col("as_read")))
        plain = read.select("word", "as_read") if rest is None else read.select("word", "as_read").join(rest.select("word"), "word", "left_anti")
        plain = plain.join(best.select("as_read", "spelling"), "as_read").select("word", "as_read", "spelling")
        rest = plain if rest is None else rest.unionByName(plain)
    return vocabulary, None if rest is None else checkpoint(rest)


@F.pandas_udf(T.StringType())
def _pattern_udf(words: pd.Series) -> pd.Series:
    """What words read as with WILD for their one foreign letter, composed as _read_udf's; null for words without one."""
    out = []
    for w in words:
        places = foreign_letters(w)
        read = _as_read(w) if places else ""
        out.append("".join(WILD if k in places else c for k, c in enumerate(read)) or None)
    return pd.Series([None if x is None else unicodedata.normalize("NFC", x) for x in out], dtype=object)


@F.pandas_udf(T.StringType())
def _read_udf(words: pd.Series) -> pd.Series:
    """What words read as, composed, which is the table's form of them; null for those that no spelling is sought for."""
    read = [_as_read(w) for w in words]
    return pd.Series([unicodedata.normalize("NFC", x) if x[:1].isalpha() else None for x in read], dtype=object)


def with_rest(df: DataFrame, rest: DataFrame | None) -> DataFrame:
    """``df`` with rest, the (word, spelling) of the words of its column ``text`` that lie beyond the vocabulary."""
    kind = "array<struct<word: string, spelling: string>>"
    if rest is None:
        return df.withColumn("rest", F.lit(None).cast(kind))
    texts = df.select("text").where("text is not null").distinct()
    words = texts.select("text", F.explode(F.array_distinct(_words_of("text"))).alias("word"))
    found = words.join(rest.select("word", "spelling"), "word").groupBy("text").agg(F.collect_list(F.struct("word", "spelling")).alias("rest"))
    return df.join(found, "text", "left").select(*df.columns, "rest")


#: The last vocabulary that the driver sent, with its application: several tables are brought to one form by it.
_last: list = [None, None, None, ""]


def _sent(spark: SparkSession, vocabulary: list[tuple[str, int]]) -> tuple[Broadcast, str]:
    """A vocabulary at the workers and its key there: sent once, so that a worker makes its trie once."""
    application = spark.sparkContext.applicationId
    if _last[0] != application or _last[1] is not vocabulary:
        _last[:] = [application, vocabulary, spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex]
    return _last[2], _last[3]


def canonical_forms(df: DataFrame, vocabulary: list[tuple[str, int]], rest: DataFrame | None = None) -> DataFrame:
    """``df`` with form, its column ``text`` in canonical spellings, and reading, the key by which forms are compared
    and searched. Each row passes through Python once. Both arguments are those of canonical_vocabulary.

    The key is what the form reads as: the same for texts that read the same, whatever the vocabulary's size. Null stays
    null, an empty or invisible text gives empty ones.
    """
    shared, key = _sent(df.sparkSession, vocabulary)
    fields = T.StructType([*df.schema.fields, T.StructField("form", T.StringType()), T.StructField("reading", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _made:
            _made.clear()
            _made[key] = Canonical(shared.value)
        form = _made[key]
        for b in batches:
            more = b["rest"] if rest_given else [None] * len(b)
            forms = [form(x, r) for x, r in zip(b["text"], more, strict=True)]
            b = b.assign(form=forms, reading=[reading(x) for x in forms])
            yield b.drop(columns="rest") if rest_given else b

    rest_given = rest is not None
    return (with_rest(df, rest) if rest_given else df).mapInPandas(run, fields)


def quotes(functions: DataFrame, links: DataFrame) -> DataFrame:
    """(place, text_id, box_id, text) of each quote with the box that it cites; a row sent twice counts once."""
    # Arrays are exploded one by one: flattened, a null one would take all of its row with it.
    of_functions = (
        functions.select(F.explode("functions.supports").alias("x")).select(F.explode("x").alias("s"))
        .where("s.kind = 'raw_ocr'")
        .select(F.lit("function").alias("place"), F.col("s.support_id").alias("text_id"), F.col("s.reference_id").alias("box_id"), F.col("s.quote").alias("text"))
    )
    of_drafts = links.select(F.explode("functional_drafts.supports").alias("x")).select(F.explode("x").alias("s")).select(
        F.lit("draft").alias("place"), F.col("s.support_id").alias("text_id"), F.col("s.item_id").alias("box_id"), F.col("s.quote").alias("text")
    )
    return of_functions.unionByName(of_drafts).where("text_id is not null and box_id <> '' and text <> ''").distinct()


def lines_and_quotes(lines: DataFrame, functions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and quotes, each with its canonical form. Of lines with the same line_id and text one stays."""
    rows = lines.where("line_id is not null").select("line_id", "box_id", "text").distinct()
    return _formed(lines, rows, quotes(functions, links), whole=True)


def _formed(lines: DataFrame, *parts: DataFrame, whole: bool = False) -> tuple[DataFrame, ...]:
    """``parts`` with the canonical form of their text; the vocabulary is that of all lines and of the last part. Words
    beyond it cost a join; those that do not change the reading are left out unless ``whole``."""
    vocabulary, rest = canonical_vocabulary(lines.select("text").unionByName(parts[-1].select("text")), VOCABULARY_WORDS, whole)
    return tuple(canonical_forms(df, vocabulary, rest) for df in parts)


def same_reading(lines: DataFrame, functions: DataFrame, links: DataFrame) -> DataFrame:
    """(place, text_id, line_id): texts that read the same and differ in characters.

    place function and draft: a quote and a line of the box that it cites, the quote reading as a part of the line
    without being contained in it. place line: two lines of a box. Null boxes match nothing, nor do null texts or texts
    in which nothing can be seen. White space at the ends, and how much of it there is, does not count.

    Boxes without quote whose lines are all spelled alike have no pairs and leave before any text is read: what a box
    has is aggregated by hashes, so that a box of many lines costs a row a task.
    """
    rows = lines.where("line_id is not null and box_id is not null and text is not null").select("line_id", "box_id", "text")
    cited = checkpoint(quotes(functions, links))
    box = F.xxhash64("box_id").alias("box")
    several = (
        rows.select(box, F.xxhash64("text").alias("t")).groupBy("box").agg(F.min("t").alias("x"), F.max("t").alias("y")).where("x <> y").select("box")
    )
    asked = checkpoint(several.unionByName(cited.select(box)).distinct())
    rows, cited = _formed(lines, rows.withColumn("box", box).join(asked, "box", "left_semi").drop("box"), spread(cited))
    rows = checkpoint(rows.where("reading <> ''").drop("form"))
    quoted = cited.where("reading <> ''").select("place", "text_id", "box_id", F.col("text").alias("quote"), F.col("reading").alias("part"))
    # A box may have a third of all lines, or of all quotes: lines of such a box are parted, its quotes go to each part.
    lines_of = rows.groupBy("box_id").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_ROWS).select("box_id")
    hot = bounded_broadcast(checkpoint(lines_of.withColumn("hot", F.lit(True))))
    part_of = F.when(F.col("hot"), F.pmod(F.xxhash64("line_id", "text"), F.lit(PARTS))).otherwise(0).cast("int")
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    in_line = (
        quoted.join(hot, "box_id", "left").withColumn("salt", F.explode(parts)).drop("hot")
        .join(rows.join(hot, "box_id", "left").withColumn("salt", part_of).drop("hot"), ["box_id", "salt"])
        .where(F.contains("reading", "part") & ~F.contains("text", "quote"))
        .select("place", "text_id", "line_id")
    )
    # Lines of a box meet by what they read: a box of many lines is no hot key. Only groups of several spellings go on.
    key = ["box_id", "reading"]
    pairs_of = rows.groupBy(*key).agg(F.min("text").alias("x"), F.max("text").alias("y")).where("x <> y").select(*key)
    some = rows.join(pairs_of, key, "left_semi")
    a, b = (some.select(*key, F.col("line_id").alias(f"{x}_id"), F.col("text").alias(f"{x}_text")) for x in "ab")
    pairs = a.join(b, key).where("a_id < b_id and a_text <> b_text").select(F.lit("line").alias("place"), F.col("a_id").alias("text_id"), F.col("b_id").alias("line_id"))
    return in_line.unionByName(pairs).distinct()
