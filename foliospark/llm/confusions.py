"""Characters that recognition takes for one another, and the weighted edit distance that knows them."""

from __future__ import annotations

from foliospark.llm.reading import reading

# What is read, and what stands on the page. Pairs of single characters hold in both directions.
SINGLE = """
c e  n u  f t  a o  i l  b h  g q  h k  v y  u v  r n  t l  i j  r v
I l  O Q  C G  E F  P R  B R  S B  U V  D O
е с  г т  л п  н п  и н  ш щ  ц щ  б в  ь ъ  з э  к н  м н  и п
र स  क फ  ब व  घ ध  प ष  म भ  य थ  ड ङ  त न
น ฬ  ธ ร  ค ฅ  ด ฒ  ช ฐ  ท ฑ  บ ษ  ค ด  ต ด  พ ฟ  ม น  ผ พ  ข ช  บ ป
水 永  夫 夭  木 本  工 于  車 東  長 辛  軸 軒  輪 輸  織 識  磨 麻  而 面  竹 付  匠 匝  槽 糟  機 譏  轉 傳
鐵 鋨  人 入  其 甚  右 石  於 淤  經 徑  滑 猾  凡 凢  梁 粱  弟 第  絲 綫  図 凶  粉 紛  柄 怲  鉄 鈑
大 犬  日 曰  土 士  未 末  己 已  千 干  天 夫  開 閒  問 間  王 玉  今 令  力 刀  白 自  目 且  牛 午  石 古
"""

# Digits and the letters for which they are read.
DIGITS = "0:oOоО 1:lItі 5:sSѕЅ 6:bбéG 8:BВ 9:gq 3:зЗэ 4:чA 2:z"

# Groups of letters that are read for one another, in both directions.
GROUPS = "cl d  rn m  vv w  ri n  li h  ii ü  ьі ы  ii u  nn rm  in m  ni m  iu m  rl n  fi h  b ss  lc k  lz k  ci d  ln h  tl d"

#: Costs: a pair of the tables above, any other substitution, a letter too many or too few.
PAIR, OTHER, GAP = 0.3, 1.0, 1.2


def _tables() -> tuple[frozenset[tuple[str, str]], dict[str, list[str]]]:
    single, groups = set(), {}
    flat = reading(SINGLE).split()
    for a, b in zip(flat[::2], flat[1::2], strict=True):
        single |= {(a, b), (b, a)}
    single = {(a, b) for a, b in single if a != b}
    for part in DIGITS.split():
        digit, letters = part.split(":")
        single |= {(digit, x) for x in reading(letters)}
    flat = reading(GROUPS).split()
    for a, b in zip(flat[::2], flat[1::2], strict=True):
        groups.setdefault(a, []).append(b)
        groups.setdefault(b, []).append(a)
    return frozenset(single), groups


SINGLE_PAIRS, GROUP_PAIRS = _tables()


def confusion_distance(read: str, meant: str, most: float = 1.0) -> float:
    """Weighted edit distance, in the form of ``reading``, from what was read to what may stand there; above ``most`` any larger number."""
    n, m = len(read), len(meant)
    if abs(n - m) > 3:
        return 9.0
    rows = [[9.0] * (m + 1) for _ in range(n + 1)]
    rows[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            here = rows[i][j]
            if here > most:
                continue
            if i < n and j < m:
                cost = 0.0 if read[i] == meant[j] else PAIR if (read[i], meant[j]) in SINGLE_PAIRS else OTHER
                if here + cost < rows[i + 1][j + 1]:
                    rows[i + 1][j + 1] = here + cost
            for k in range(1, min(2, n - i) + 1):
                for to in GROUP_PAIRS.get(read[i : i + k], ()):
                    if meant.startswith(to, j) and here + PAIR < rows[i + k][j + len(to)]:
                        rows[i + k][j + len(to)] = here + PAIR
            if i < n and here + GAP < rows[i + 1][j]:
                rows[i + 1][j] = here + GAP
            if j < m and here + GAP < rows[i][j + 1]:
                rows[i][j + 1] = here + GAP
    return rows[n][m]


def partners() -> dict[str, str]:
    """Character to the characters for which it may stand."""
    out: dict[str, str] = {}
    for a, b in sorted(SINGLE_PAIRS):
        out[a] = out.get(a, "") + b
    return out
