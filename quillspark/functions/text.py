"""Native column expressions that parse prose: words, tokens, sentences, and counts of its tells."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import ABBREVIATIONS, BRIDGES, CLOSERS, EM_DASH, HEDGES, LIMITERS, MATTR_WINDOW, SMART_QUOTES, VOCABULARY

#: White space as Unicode sees it, with the separators that Java's \s leaves out.
WS = r"\s\x0b\x1c-\x1f\x85\p{Z}"
#: A word character: letters and numbers of any script. Java's \w is ASCII, and with (?U) also has marks.
WORD = r"[\p{L}\p{N}_]"
#: White space but for blanks, line ends and tabs. The class that comes first is told by one comparison.
ODD_SPACE = rf"[^ -~](?<=[{WS}])"
FOLDED = "ıſİ\u212a"
BEFORE, AFTER = rf"(?<!{WORD})", rf"(?!{WORD})"
TOKEN = r"[A-Za-z]+(?:'[A-Za-z]+)?"
PLACE_BITS = 20  # of a number that has a token's place beside its hash
MARK, VETO = "\u0001", "\u0002"  # stand between sentences, and behind what ends none, while a text is split; taken out of texts first


def _java(text: str) -> str:
    """A literal for Java's patterns with any white space where it has a space."""
    return rf"[{WS}]+".join(re.sub(r"([.\\+*?\[^\]$(){}|])", r"\\\1", part) for part in text.split(" "))


#: What a token before a sentence's end is made of; VETO is put behind a token that ends no sentence.
IN_TOKEN = r"\p{L}\p{N}.'’"


def _vetoes(known: list[str]) -> str:
    """The pattern of a token, from its start up to a run of .!?, that is one of `known` or a single letter but for dots and
    quotes around it. A further match goes on from the last one, over dots and quotes to the next run. Matches end where a veto belongs."""
    words = "|".join(re.sub(r"([.])", VETO + r"\\\1", a) for a in sorted(known, key=lambda a: (-len(a), a)))
    letter, near = ("", "") if VETO in words else (r"|\p{L}", rf"(?=[.'’]*+\p{{L}}{{1,{max(map(len, known))}}}+['’]*+[.!?])")  # most tokens are told by what follows them
    return rf"(?:(?<![{IN_TOKEN}{VETO}]){near}[.'’]*+(?:(?iu:{words}){letter})['’]*+|(?!\A)\G[.]++['’]++)(?=[.!?])"


#: Plain tokens first; those with dots within them, such as u.s, have a veto behind their first letter by then.
VETOES = [_vetoes([a for a in ABBREVIATIONS if "." not in a]), _vetoes([a.strip(".") for a in ABBREVIATIONS if "." in a.strip(".")])]
_CLOSED = rf"[{''.join(chr(92) + c if c in '])' else c for c in CLOSERS)}]*+(?=\p{{IsUppercase}}|[{WS}]++(?!\p{{IsLowercase}})|\z)"
#: A sentence's end: a run of .!? with its closers, unless vetoed or followed by a lower-case letter or, at once, by anything but an upper-case one.
BOUNDARY = rf"(?=[.!?])(?<![.!?{VETO}])[.!?]++{_CLOSED}"
#: The same in one pass, without vetoes in the text: it looks back from each run, first for three letters that end no abbreviation. It sees three dots and quotes on each side of a token;
#: texts where a token may have more, or go on behind a dot and quotes, have FAR, which needs one of NEAR.
BOUNDARY_AT_ONCE = (
    rf"[.!?](?<![.!?][.!?])(?>(?<=[a-z]{{3}}[.!?])(?<!(?:{'|'.join(sorted({a[-3:] for a in ABBREVIATIONS if re.fullmatch('[a-z]{3,}', a)}))})[.!?])"
    rf"|(?<!(?<![{IN_TOKEN}])[.'’]{{0,3}}(?iu:{'|'.join(a.replace('.', '[.]') for a in sorted(ABBREVIATIONS, key=lambda a: (-len(a), a)))}|\p{{L}})['’]{{0,3}}[.!?]))"
    rf"[.!?]*+{_CLOSED}"
)
FAR = r"[.'’]{4}|[.]['’]++[.!?]"
QUOTES = "'’"
NEAR = [a + b for a in ".'’" for b in ".'’"]
NOT_JUST = rf"(?iu){BEFORE}not[{WS}]+(?:{'|'.join(LIMITERS)}){AFTER}[^.!?]{{1,80}}{BEFORE}but{AFTER}"
TRIAD = rf"(?iu){BEFORE}{WORD}+,[{WS}]+{WORD}+,[{WS}]+and[{WS}]+{WORD}+{AFTER}"
HEDGE = rf"(?iu){BEFORE}it[{WS}]+is[{WS}]+(?:{'|'.join(_java(h) for h in HEDGES).replace('well-known', f'well[-{WS}]known')}){AFTER}"
BRIDGE = rf"(?iu){BEFORE}(?:{'|'.join(map(_java, BRIDGES))}){AFTER}"

#: Three of them for a text in lower case with single blanks and without a letter of FOLDED. A pattern that begins with some plain letters is
#: sought by them. Between 'well' and 'known' only one white space counts, which such a text doesn't tell from more.
EVEN_TRIAD = rf"{BEFORE}{WORD}++, {WORD}++, and {WORD}"
EVEN_HEDGE = rf"it is (?<!{WORD}it is )(?:{'|'.join(map(re.escape, HEDGES))}){AFTER}"
EVEN_BRIDGE = rf"(?<![a-z]){BEFORE}(?:{'|'.join(BRIDGES)}){AFTER}"


def _overlap(a: list[str], b: list[str]) -> bool:
    """Whether a hit of one word list can share words with a hit of the other."""
    if len(a) > len(b):
        a, b = b, a
    inside = any(b[k : k + len(a)] == a for k in range(len(b) - len(a) + 1))
    return inside or any(x[-k:] == y[:k] for x, y in ((a, b), (b, a)) for k in range(1, len(a) + 1))


def vocabulary_groups(terms: list[str]) -> list[list[str]]:
    """The terms in as few groups as a greedy colouring of their overlaps finds: within a group no two hits share a word, so one
    alternation counts all of its terms as if each were alone. Terms that overlap, nested ones and repeated ones fall to different groups."""
    words = {t: re.findall(r"\w+", t.casefold()) or [t] for t in terms}
    groups: list[list[str]] = []
    held: list[dict[str, list[str]]] = []  # of each group, the terms by word
    for t in sorted(terms, key=lambda t: (-len(t), t)):
        for group, by_word in zip(groups, held):
            if not any(_overlap(words[t], words[o]) for o in {o for w in words[t] for o in by_word.get(w, ())}):
                break
        else:
            groups.append(group := [])
            held.append(by_word := {})
        group.append(t)
        for w in words[t]:
            by_word.setdefault(w, []).append(t)
    return groups


def _alternation(terms: list[str], before: str = rf"(?iu){BEFORE}") -> str:
    def literal(t: str) -> str:
        return re.sub(r"([.\\+*?\[^\]$(){}|])", r"\\\1", t)

    listed = "|".join(map(literal, terms))
    if all("a" <= t[:1] <= "z" for t in terms):  # by first letter, so that most words are told by it
        firsts = sorted({t[0] for t in terms})
        listed = "|".join(f"{c}(?:{'|'.join(literal(t[1:]) for t in terms if t[0] == c)})" for c in firsts)
    return rf"{before}(?:{listed}){AFTER}"


def vocabulary_patterns(terms: list[str]) -> list[str]:
    """Patterns that together have each hit of each term once."""
    return [_alternation(g) for g in vocabulary_groups(terms)]


def lower_patterns(terms: list[str]) -> list[str]:
    """The same for ASCII terms in lower case and a text in lower case without a letter of FOLDED. Most places are told by the letter before them."""
    return [_alternation(g, rf"(?<![a-z]){BEFORE}") for g in vocabulary_groups(terms)]


def vocabulary_stems(terms: list[str]) -> list[str]:
    """Strings of which a text in lower case has one at least if it has a term, unless it has a letter of FOLDED; none where terms have
    other than ASCII lower-case letters and signs."""
    if not all(t.isascii() and t and t == t.lower() for t in terms):
        return []
    by_start: dict[str, list[str]] = {}
    for t in terms:
        by_start.setdefault(t[:5], []).append(t)
    return [commonprefix(group) for group in by_start.values()]


def vocabulary_runs(terms: list[str]) -> list[str]:
    """Runs of ASCII letters, the longest of each term, of which a text in lower case has one at least, whole, if it has a term, unless it has a
    letter of FOLDED; none where terms have other than ASCII lower-case letters and signs, or no letter."""
    runs = [max(re.findall("[a-z]+", t), key=len, default="") for t in terms]
    return sorted(set(runs)) if all(runs) and all(t.isascii() and t == t.lower() for t in terms) else []


VOCABULARY_PATTERNS = vocabulary_patterns(VOCABULARY)
VOCABULARY_STEMS = vocabulary_stems(VOCABULARY)
LOWER_PATTERNS = lower_patterns(VOCABULARY)


def pinned(x: Column) -> Column:
    """The same value, computed where it stands. The optimiser moves conditions below projections and puts the
    projection's expressions into them, so a costly one would run once for each mention; it doesn't move past
    expressions that depend on the row's place, as this one formally does."""
    return F.when(F.monotonically_increasing_id() >= 0, x)


def within(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once however often f mentions it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def replaced(text: Column, old: str, new: str) -> Column:
    """A text with `new` for `old`. To look for something costs much less than to replace it."""
    return within(text, lambda t: F.when(F.contains(t, F.lit(old)), F.replace(t, F.lit(old), F.lit(new))).otherwise(t))


def without(text: Column, char: str) -> Column:
    return replaced(text, char, "")


def octets_but(text: Column, char: str) -> Column:
    """The bytes of a text that are none of `char`, which most texts have."""
    return F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def has(text: Column, parts: Iterable[str]) -> Column:
    """Whether any of `parts` is in a text. This looks at bytes, at a small part of what a pattern costs."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def plain(text: Column) -> Column:
    """A text without nulls and without the sentence mark."""
    return without(F.coalesce(text.cast("string"), F.lit("")), MARK)


def spaced(text: Column) -> Column:
    """A text with a blank for each run of white space. Line ends and tabs, which are common, need no pattern."""
    blank = replaced(replaced(text, "\n", " "), "\t", " ")
    blank = within(blank, lambda t: F.when(t.rlike(ODD_SPACE), F.regexp_replace(t, f"[{WS}]+", " ")).otherwise(t))
    return within(blank, lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t))


def folded(text: Column) -> Column:
    """Whether a text has one of the letters beyond ASCII that equal an ASCII one where case is ignored."""
    return (F.octet_length(text) != F.length(text)) & has(text, FOLDED)


def _known(fold: Column | None, text: Column) -> Column:
    return folded(text) if fold is None else fold


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_char(text: Column, char: str) -> Column:
    return F.when(F.contains(text, F.lit(char)), ((F.octet_length(text) - octets_but(text, char)) / len(char.encode())).cast("int")).otherwise(F.lit(0))


def word_count(text: Column) -> Column:
    return blank_words(spaced(text))


def blank_words(text: Column) -> Column:
    """The words of a text with single blanks."""
    return within(F.trim(text), lambda t: F.when(t == "", F.lit(0)).otherwise(F.octet_length(t) - octets_but(t, " ") + 1))


def per_1k(words: Column) -> Column:
    return F.when(words > 0, F.lit(1000.0) / words).otherwise(F.lit(0.0))


def tokens(text: Column, lowered: Column | None = None, fold: Column | None = None) -> Column:
    """Lower-case ASCII words, contractions kept. `lowered` is the text in lower case, which has the same ones but where a letter of
    FOLDED becomes an ASCII one; there each match is lowered by itself. `fold` here and below is folded(text), where that is known already."""
    alone = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    return alone if lowered is None else F.when(_known(fold, text), alone).otherwise(F.regexp_extract_all(lowered, F.lit("[a-z]++(?:'[a-z]++)?"), F.lit(0)))


def _ended_in_passes(text: Column) -> Column:
    text = F.regexp_replace(text, VETOES[0], "$0" + VETO)
    text = within(text, lambda t: F.when(F.contains(t, F.lit(VETO + ".")), F.regexp_replace(t, VETOES[1], "$0" + VETO)).otherwise(t))
    return F.regexp_replace(text, BOUNDARY, "$0" + MARK)


def _ended(text: Column) -> Column:
    """A text with MARK behind each sentence's end, and perhaps with vetoes, which stand within words."""
    far = lambda t: (F.contains(t, F.lit("....")) | (has(t, QUOTES) & has(t, NEAR))) & t.rlike(FAR)
    return within(without(text, VETO), lambda t: F.when(far(t), _ended_in_passes(t)).otherwise(F.regexp_replace(t, BOUNDARY_AT_ONCE, "$0" + MARK)))


def _marked(text: Column) -> Column:
    return F.split(without(_ended(text), VETO), MARK)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+$", "")


def sentences(text: Column) -> Column:
    """The sentences of a text, trimmed, without empty ones."""
    return F.filter(F.transform(_marked(text), strip), lambda s: s != "")


def sentence_lengths(text: Column) -> Column:
    """Of a text with single blanks."""
    text = F.when(F.contains(text, F.lit(VETO)), spaced(without(text, VETO))).otherwise(text)  # VETO may stand alone
    # the blank behind an end goes with it, so that pieces have none at their sides
    pieces = F.array_remove(F.split(F.replace(_ended(F.trim(text)), F.lit(MARK + " "), F.lit(MARK)), MARK), "")
    return F.transform(pieces, lambda s: F.octet_length(s) - octets_but(s, " ") + 1)


def triads(text: Column, even: Column, fold: Column | None = None) -> Column:
    """`even` is the text in lower case with single blanks. Few texts have the end of a list, which is found at its comma."""
    return F.when(F.contains(even, F.lit(", and ")), F.when(_known(fold, text), count(text, TRIAD)).otherwise(count(even, EVEN_TRIAD))).otherwise(F.lit(0))


def not_just(text: Column, lowered: Column) -> Column:
    """`lowered` is the text in lower case; the letters of both words have no other forms."""
    return F.when(F.contains(lowered, F.lit("not")) & F.contains(lowered, F.lit("but")), count(text, NOT_JUST)).otherwise(F.lit(0))


def hedges(text: Column, even: Column, fold: Column | None = None) -> Column:
    """`even` is the text in lower case with single blanks."""
    found = F.when(F.contains(even, F.lit("it is well known")), count(text, HEDGE)).otherwise(count(even, EVEN_HEDGE))
    return F.when(_known(fold, text), count(text, HEDGE)).when(F.contains(even, F.lit("it is ")), found).otherwise(F.lit(0))


def bridges(text: Column, even: Column, fold: Column | None = None) -> Column:
    """`even` is the text in lower case with single blanks."""
    return F.when(_known(fold, text), count(text, BRIDGE)).when(has(even, BRIDGES), count(even, EVEN_BRIDGE)).otherwise(F.lit(0))


def em_dashes(text: Column) -> Column:
    return count_char(text, EM_DASH)


def smart_quotes(text: Column) -> Column:
    return reduce(lambda a, b: a + b, (count_char(text, c) for c in SMART_QUOTES))


def vocabulary_hits(text: Column, patterns: list[str] = VOCABULARY_PATTERNS, stems: list[str] = VOCABULARY_STEMS) -> Column:
    """Every hit in a text in lower case as the term that it is, those of a pattern in the order of the text. `stems` are those of the
    patterns' terms, or none."""
    hits = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda t: F.translate(F.lower(t), "ſ", "s")) for p in patterns]
    hits = hits[0] if len(hits) == 1 else F.concat(*hits)
    return F.when(has(text, [*stems, *FOLDED]), hits).otherwise(F.array().cast("array<string>")) if stems else hits


def lower_hits(lowered: Column, patterns: list[str] = LOWER_PATTERNS) -> Column:
    """The same hits of `lower_patterns` in a text in lower case without a letter of FOLDED."""
    hits = [F.regexp_extract_all(lowered, F.lit(p), F.lit(0)) for p in patterns]
    return hits[0] if len(hits) == 1 else F.concat(*hits)


def may_have(tokens_col: Column, lowered: Column, runs: list[str]) -> Column:
    """Whether a text without a letter of FOLDED, given with its tokens and in lower case, has one of `runs` between other than ASCII letters. Looking its
    words up in a set costs much less than to look for each run in the text."""
    parted = F.split(F.replace(F.array_join(tokens_col, " "), F.lit("'"), F.lit(" ")), " ")
    return F.arrays_overlap(F.when(F.contains(lowered, F.lit("'")), parted).otherwise(tokens_col), F.array(*map(F.lit, runs)))


def mattr_numbers(tokens_col: Column, window: int = MATTR_WINDOW) -> Column:
    """For `mattr`: whole numbers of a token's hash and its place, sorted; null where it needs none. They are below 2**62, so that none less another overflows."""
    n, last, most = F.size(tokens_col), (1 << PLACE_BITS) - 1, (1 << 62) - 1
    number = lambda t, i: F.shiftleft(F.xxhash64(t), PLACE_BITS).bitwiseAND(F.lit(most)).bitwiseOR(i)
    return F.when((n > window) & (n <= last), F.sort_array(F.transform(tokens_col, number)))


def mattr(tokens_col: Column, window: int = MATTR_WINDOW, numbers: Column | None = None) -> Column:
    """Mean share of distinct tokens in a sliding window, in one row: n - w + 1 windows of w tokens, less a token for each window that has
    it and the same token's place before, p: min(p, n - w) - max(i - w + 1, 0) + 1 windows for token i, if i - p < w. Sorting finds p, so the
    work is n log n and nothing is shuffled. What is sorted are whole numbers of a hash and the place, and tokens are compared where they
    seem equal; if they differ, and in texts of more than 2**20 tokens, (token, place) pairs are sorted. `numbers` is a column of `mattr_numbers`;
    standing by itself it is sorted as plain longs."""
    n, last = F.size(tokens_col), (1 << PLACE_BITS) - 1

    def repeated(i: Column, p: Column) -> Column:
        return F.least(p, n - window) - F.greatest(i - (window - 1), F.lit(0)) + 1

    def total(pairs: Column, each: Callable[[Column, Column], Column]) -> Column:
        """The first one has none before it, so that what `each` compares is null."""
        found = F.transform(pairs, lambda x, k: each(x, F.get(pairs, k - 1)))
        return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x)

    def by_hash(x: Column, y: Column) -> Column:
        i, p = x.bitwiseAND(last).cast("int"), y.bitwiseAND(last).cast("int")
        return F.when(x - y < window, F.when(F.get(tokens_col, i) == F.get(tokens_col, p), repeated(i, p))).otherwise(F.lit(0))

    def by_token(x: Column, y: Column) -> Column:
        return F.when((x["t"] == y["t"]) & (x["i"] - y["i"] < window), repeated(x["i"], y["i"])).otherwise(F.lit(0))

    hashed = within(mattr_numbers(tokens_col, window), lambda x: total(x, by_hash)) if numbers is None else total(numbers, by_hash)
    exact = within(F.sort_array(F.transform(tokens_col, lambda t, i: F.struct(t.alias("t"), i.alias("i")))), lambda x: total(x, by_token))
    distinct = F.lit(window).cast("long") * (n - (window - 1)) - F.coalesce(hashed, exact)
    return F.when(n == 0, F.lit(1.0)).when(n <= window, F.size(F.array_distinct(tokens_col)) / n).otherwise(distinct / (F.lit(window).cast("double") * (n - (window - 1))))


def shown(x: Column, pattern: str) -> Column:
    """A number as text, after a pattern such as 0.00."""
    return F.call_function("format_number", x, F.lit(pattern))


def rounded(x: Column, digits: int) -> Column:
    """Rounding of the exact binary value, ties to even, as Python does it; Spark's own rounds the decimal text.

    x times 10**digits is rounded once, to y; what that leaves out is found without error from the halves of both factors
    (Dekker's product), and says on which side of a half the exact product lies where y is one. Beyond 2**52 units of the last
    digit, where y has no halves, the number's own text is rounded."""
    m = float(10**digits)
    high, low = _halves(m)

    def exact(v: Column) -> Column:
        y = v * m
        split = v * float((1 << 27) + 1)
        v_high = split - (split - v)
        v_low = v - v_high
        error = ((v_high * high - y) + v_high * low + v_low * high) + v_low * low
        whole = F.floor(y).cast("double")
        up = (y - whole > 0.5) | ((y - whole == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 != 0))))
        return F.when(F.abs(y) < float(1 << 52), (whole + F.when(up, 1.0).otherwise(0.0)) / m).otherwise(shown(v, "0." + "0" * digits).cast("double"))

    return F.get(F.transform(F.array(x), exact), F.lit(0))  # x is mentioned once, however often the formula needs it


def _halves(x: float) -> tuple[float, float]:
    """Two numbers of at most 26 digits each whose sum is x."""
    split = x * float((1 << 27) + 1)
    high = split - (split - x)
    return high, x - high
