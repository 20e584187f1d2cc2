"""Per-document text statistics, and text types from noisy labelling functions.

One pass over the texts gives the statistics of each. Thresholds on them are labelling functions that vote for a type
or abstain; expectation-maximization over the counts of vote patterns of all documents learns how each function errs
(a confusion table per function) and the shares of the types, from nothing but the agreements; the posterior of a
document's pattern is its type. Patterns are few, whatever the number of documents: at most the product of the numbers
of answers, PATTERNS below, so their counts are the only thing that reaches the driver.

Defined cases: a null text has null statistics, an empty or blank one zeros; both have no type (null). Repeated rows
are rows of their own. An empty table gives an empty result. Common words come as a table (lang, word); a null or
empty word is ignored. Other columns aren't read. Texts are read whole; no language tag is trusted.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("prose", "list", "table", "junk")
WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
STOPS, CLOSERS = ".!?…。！？؟۔।", "\"')]»”’」』）"
MARKER = regex.compile(r"^\s*(?:[-*•·◦‣▪–—+>]\s+|\(?\d{1,3}[.):]\s+|#\d+\s|\(?[a-zA-Z][.)]\s+|\[[ xX]?\]\s*|[☐☑☒✓✔✗□■]\s*)")
MARKS = frozenset("-*•·◦‣▪–—+>(#[☐☑☒✓✔✗□■")  # signs that MARKER can begin with
NUMBER = regex.compile(r"^[-+]?[\d.,:%]+$|^$")
LOG = regex.compile(r"\b\d{1,2}:\d{2}:\d{2}\b|0x[0-9a-fA-F]{4,}|\b[A-Za-z_]+=\S+|\b[VDIWEF]/\w+")
HARD = regex.compile(r"[bcdfghjklmnpqrstvwxz]{5,}|^[bcdfghjklmnpqrstvwxz]{3,}$", regex.I)
ITEM = regex.compile(r"\s*[;,>|/、，；]\s+|[、，；]|\s+[-•·]\s+|\n")
SENTENCE = regex.compile(r"[.!?…。！？؟۔]+[\"')\]»”’」』）]*(?=\s|\p{Han}|$)")
AMOUNT = regex.compile(r"[:：]\s*\d+\s*[.,;]?\s*$")
SPEAKER = regex.compile(r"^\s*[\p{L}][\p{L}\p{M} ]{0,24}:\s+(?=\S)")
LETTERS, DIGITS, SPACES, SIGNS, CODES, SEPARATORS, QUOTES, WIDES = (1 << k for k in range(8))
BITS = np.arange(7, dtype=np.uint8)[:, None]
DELIMITERS = (",", ";", "\t", "|", "  ")
COLUMNS = (
    "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "end_punct_share", "common_share", "n_lines",
    "list_share", "table_share", "junk_share", "prose_share", "fresh_share", "packed_ratio", "hard_share", "item_share",
)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The kinds of every code point, as bits."""
    table = np.zeros(0x110000, np.uint8)
    table[0xE0100:0xE01F0] = LETTERS  # selectors; nothing else beyond the third plane is a letter, number or space
    for k in range(0x33480):
        c = chr(k)
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            table[k] |= LETTERS
        elif kind == "N":
            table[k] |= DIGITS
        if c.isspace():
            table[k] |= SPACES
    blocks = ((0x4E00, 0xA000), (0x3400, 0x4DC0), (0x3005, 0x3008), (0x3041, 0x30FF), (0x0E01, 0x0E60), (0xF900, 0xFB00), (0x20000, 0x31350))
    for a, b in blocks:  # scripts without spaces
        table[a:b] |= np.where(table[a:b] & LETTERS, SIGNS, 0).astype(np.uint8)
    for bit, signs in ((CODES, "{}<>\\=_|~^`#@[]"), (SEPARATORS, ";,>|/、，；•·-"), (QUOTES, "'’"), (WIDES, "、，；")):
        for c in signs:
            table[ord(c)] |= bit
    return table


DASHES = tuple(map(ord, "-•·"))


def strings(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


class Common:
    """The frequent words, and what is known of the words met so far: bit 1 common, bit 2 hard to say."""

    def __init__(self, words: set[str]):
        self.words = {w for w in words if not UNSPACED.search(w)}
        self.signs = words - self.words
        self.known: dict[str, int] = {}

    def shares(self, words: list[str]) -> tuple[float, float]:
        """The shares of common and of hard words."""
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = (w in self.words) + 2 * is_hard(w)
        kinds = bytes(map(known.__getitem__, words))
        both, n = kinds.count(3), max(1, len(words))
        return (kinds.count(1) + both) / n, (kinds.count(2) + both) / n


KEPT_WORDS = 200_000


def is_hard(word: str) -> bool:
    """A run of Latin letters that nobody could say."""
    return len(word) > 2 and word.isascii() and bool(HARD.search(word))


def ended(line: str) -> bool:
    """Whether a sentence ends with the line. line: without white space at its ends, not empty."""
    return line.rstrip(CLOSERS)[-1:] in STOPS


def marked(line: str):
    """The match of a list's marker at the line's start, or None; line as written, its first signs tell most others."""
    head = line.lstrip()[:2]
    c = head[:1]
    if c in MARKS or c.isdigit() or head[1:] in (".", ")") and c.isascii() and c.isalpha():
        return MARKER.match(line)
    return None


def fields(line: str, d: str) -> list[str]:
    if d == "  ":
        return [x for x in regex.split(r"\s{2,}|\t", line.strip()) if x]
    line = line.rstrip("\r\n ") if d == "\t" else line.strip()
    return [x.strip() for x in line.strip("|" if d == "|" else "").split(d)]


def table_rows(lines: list[str], digits: list[int], words: list[int], text: str) -> list[bool]:
    """Which lines are rows of a table: neighbours with the same number of fields, short ones or many of them numbers.

    digits, words: how many each line has."""
    best = [False] * len(lines)
    for d in DELIMITERS:
        if d not in text:
            continue
        loose, least = (1, 2) if d == "  " else (0, 3)
        cut = [fields(x, d) if d in x else [] for x in lines]
        size = [len(c) for c in cut]
        if d == "  " and sum(size) > 12 * len(lines):  # words set wide, not columns
            continue
        ok = [n >= least and (w <= 2.5 * n or sum(bool(NUMBER.match(v)) for v in c) >= 0.4 * n) for n, w, c in zip(size, words, cut)]
        for k in range(len(lines)):
            if ok[k] and any(0 <= j < len(lines) and ok[j] and max(size[j], size[k]) >= 3 and abs(size[j] - size[k]) <= loose for j in (k - 1, k + 1)):
                best[k] = True
    for k, x in enumerate(lines):  # rows of bare numbers
        if digits[k] and not best[k] and 8 * digits[k] >= len(x):
            v = x.split()
            if len(v) >= 2 and sum(bool(NUMBER.match(t)) for t in v) >= 0.8 * len(v):
                best[k] = True
    return best


def fresh_share(words: list[str], unspaced: str) -> float:
    """The share of runs of six words (twelve unspaced signs) that differ; 1 for texts of fewer than twelve runs."""
    units, n = (unspaced, 12) if len(unspaced) > sum(map(len, words)) / 2 else (words, 6)
    runs = len(units) - n + 1
    if runs < 12:
        return 1.0
    return (len({units[k : k + n] for k in range(runs)}) if units is unspaced else len(set(zip(*(units[k:] for k in range(n)))))) / runs


def wrapped_at_margin(lines: list[str], bare: list[str]) -> bool:
    """Lines that were broken because the next word, or sign, didn't fit. bare: the same without white space at the ends."""
    if len(lines) < 3:
        return False
    size = [len(x.rstrip()) for x in lines]
    width = max(size)
    full = len(lines) - 1
    for n, y in zip(size, bare[1:]):
        head = 1 if y[0] >= "\u0e00" and UNSPACED.match(y) else len(y.split(maxsplit=1)[0])
        if n + 1 + head <= width - 2:
            full -= 1
            if full < 0.8 * (len(lines) - 1):
                return False
    return full >= 0.8 * (len(lines) - 1)


def word_count(text: str) -> float:
    return len(WORD.findall(text)) + len(UNSPACED.findall(text)) / 2


def listed(line: str) -> bool:
    """Five items or more within one line: most of up to four words, or all in small letters, and no sentences."""
    items = [x for x in ITEM.split(line) if x.strip()]
    if len(items) < 5 or len(SENTENCE.findall(line)) > 1:
        return False
    brief = sum(word_count(x) <= 4 for x in items)
    small = sum(x.strip()[:1].islower() or x.strip()[:1].isdigit() for x in items)
    return brief >= 0.7 * len(items) or small >= 0.9 * len(items)


def spoken(item: str, n: float) -> bool:
    """A line of talk behind a dash: a whole sentence, and not in small letters."""
    return n >= 5 and bool(item.strip()) and ended(item.strip()) and not item[:1].islower()


def common_signs(unspaced: str, common: Common) -> float:
    """A sign is half a word or less, and fewer of the frequent ones are listed."""
    return min(1.0, 2 * sum(unspaced.count(x) for x in common.signs if len(x) == 1) / max(1, len(unspaced)))


def logged(line: str) -> bool:
    """Two marks or more of machine output: clock times, addresses, settings, tags of a log."""
    may = "=" in line or "/" in line or "0x" in line or line.count(":") > 1
    return may and len(LOG.findall(line)) >= 2


def statistics(text: str, common: Common) -> tuple:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes()[codes]
    letter, digit, space, sign, code, cut, quote = ((kinds[None] >> BITS) & 1).view(bool)
    solid = len(text) - int(np.count_nonzero(space))
    if not solid:
        return (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    # words are runs of letters, and go on behind an apostrophe within them
    run = letter.copy()
    run[1:-1] |= quote[1:-1] & letter[:-2] & letter[2:]
    begins = run.copy()
    begins[1:] &= ~run[:-1]
    words = strings(np.where(run, codes, 32).astype(np.uint32)).lower().split()
    unspaced = strings(codes[sign]) if sign.any() else ""
    all_lines = text.splitlines(keepends=True)
    starts = np.cumsum([0, *map(len, all_lines[:-1])])
    stripped = [x.strip() for x in all_lines]
    full = np.array(list(map(bool, stripped)))
    lines = [x for x, f in zip(all_lines, stripped) if f]
    trimmed = list(filter(None, stripped))
    per_line = np.add.reduceat(np.stack([begins, sign, letter, digit, ~space, code, cut]), starts, axis=1, dtype=np.int32)[:, full]
    n_words, n_signs, n_letters, n_digits, n_solid, n_code, n_cuts = per_line.tolist()
    weight = list(map(len, trimmed))
    total = sum(weight)
    stop = list(map(ended, trimmed))
    rows = table_rows(lines, n_digits, n_words, text)
    share = dict.fromkeys(TYPES, 0)
    wrapped = wrapped_at_margin(lines, trimmed)
    plain = len(lines) >= 4 and not wrapped and stop.count(False) > 0.8 * len(lines)
    for k, (x, w) in enumerate(zip(lines, weight)):
        n, bare = n_words[k] + n_signs[k] / 2, n_letters[k]
        mark = marked(x)
        if rows[k]:
            kind = "table"
        elif mark and bare:
            kind = "prose" if spoken(x[mark.end() :].lstrip("\"'«“„"), n) else "list"
        elif bare < 0.4 * n_solid[k]:
            kind = "junk"
        elif n_code[k] > 0.06 * len(x) or n_digits[k] and logged(x):
            kind = "junk"
        elif n_digits[k] and AMOUNT.search(x[-24:]) or n_cuts[k] >= 4 and listed(x):
            kind = "list"
        elif n > 4 and ":" in x and SPEAKER.match(x) and not trimmed[k][:1].islower():
            kind = "prose"
        elif n <= 5 and not stop[k] and len(lines) > 2 and not wrapped:
            kind = "list"
        elif plain and n <= 14:  # one unpunctuated item a line
            kind = "list"
        else:
            kind = "prose"
        share[kind] += w
    raw = text.encode("utf-8", "surrogatepass")
    # items in one line or one a line: short ones
    parts = (codes == 10) | (kinds & WIDES != 0)
    dash = (codes == DASHES[0]) | (codes == DASHES[1]) | (codes == DASHES[2])
    dash[1:] &= ~space[:-1]  # a dash, or a dot in the middle, takes white space on both sides
    parts[:-1] |= cut[:-1] & space[1:] & ~dash[:-1]
    item = 0.0
    if np.count_nonzero(parts) >= 4:
        edge = np.concatenate([[0], np.flatnonzero(parts) + 1, [len(text)]])
        edge = edge[:-1][edge[:-1] < len(text)]
        there = np.add.reduceat(~space & ~parts, edge, dtype=np.int32) > 0
        if np.count_nonzero(there) >= 5:
            size = np.add.reduceat(begins, edge, dtype=np.int32) + (np.add.reduceat(sign, edge, dtype=np.int32) / 2 if unspaced else 0)
            item = float((size[there] <= 4).mean())
    letters, digits = int(np.count_nonzero(letter)), int(np.count_nonzero(digit))
    common_share, hard_share = common.shares(words)
    if 2 * len(unspaced) > sum(map(len, words)):
        common_share = common_signs(unspaced, common)
    return (
        len(words), int(np.count_nonzero(run)) / max(1, len(words)), (solid - letters - digits) / solid, digits / solid, stop.count(True) / len(lines), common_share,
        len(lines), *(share[t] / total for t in ("list", "table", "junk", "prose")),
        fresh_share(words, unspaced), len(zlib.compress(raw, 1)) / len(raw), hard_share, item,
    )


#: The labelling functions: name, answers. An answer is a type or None.
FUNCTIONS = (
    ("lines", ("prose", "list", "table", "junk", None)),
    ("common", ("junk", "list", "prose", None)),
    ("repeats", ("junk", None)),
    ("letters", ("junk", None)),
    ("ends", ("prose", "list", None)),
    ("items", ("list", None)),
    ("signs", ("junk", "table", None)),
    ("columns", ("table", None)),
    ("noise", ("junk", None)),
    ("width", ("list", "prose", None)),
)
#: What is learnt: junk comes in two kinds with little in common, signs that are no text and words that say nothing.
HIDDEN = ("prose", "list", "table", "noise", "babble")
TYPE_OF = (0, 1, 2, 3, 3)
#: The kinds that a function's answer junk speaks for.
JUNK_OF = {"repeats": ("babble",), "letters": ("babble",), "common": ("babble", "noise"), "signs": ("noise",), "noise": ("noise",), "lines": ("noise",)}
PATTERNS = int(np.prod([len(a) for _, a in FUNCTIONS]))


def votes(s: dict) -> list[str | None]:
    """The answer of every function to one document's statistics."""
    kinds = {k: s[f"{k}_share"] for k in TYPES}
    top = max(kinds, key=kinds.get)
    # lines that look like prose only say so if they can be read and aren't the same over and over
    if top == "prose" and not (0.08 <= s["common_share"] <= 0.75 and s["fresh_share"] >= 0.35 and s["hard_share"] <= 0.2):
        top = None
    c, n = s["common_share"], s["n_lines"]
    width = s["n_words"] / max(1, n)
    return [
        top if top and kinds[top] > 0.5 else None,
        "junk" if c > 0.75 or c < 0.015 else "list" if c < 0.2 else "prose" if c > 0.27 else None,
        "junk" if s["packed_ratio"] < 0.15 or s["fresh_share"] < 0.35 else None,
        "junk" if s["hard_share"] > 0.2 or s["mean_word_length"] > 25 else None,
        "prose" if s["end_punct_share"] >= 0.6 else "list" if s["end_punct_share"] <= 0.1 and n >= 4 else None,
        "list" if s["item_share"] > 0.6 else None,
        "junk" if s["symbol_ratio"] > 0.3 else "table" if s["digit_ratio"] > 0.2 else None,
        "table" if s["table_share"] > 0.4 else None,
        "junk" if s["junk_share"] > 0.4 else None,
        "list" if width < 6 and n >= 4 else "prose" if width > 12 else None,
    ]


def pattern(answers: list[str | None]) -> int:
    code = 0
    for (_, known), a in zip(FUNCTIONS, answers):
        code = code * len(known) + known.index(a)
    return code


def answers_of(code: int) -> list[int]:
    out = []
    for _, known in reversed(FUNCTIONS):
        code, k = divmod(code, len(known))
        out.append(k)
    return out[::-1]


def learn(counts: dict[int, int], rounds: int = 60, weight: float = 100.0) -> tuple[dict[int, np.ndarray], list[np.ndarray], np.ndarray]:
    """Posterior types of each pattern, the confusion table of each function (hidden kind x answer), the kinds' shares.

    weight: documents that the first belief counts for: a function names the right kind more often than each other one."""
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    if not len(n):
        return {}, [], np.full(len(HIDDEN), 1 / len(HIDDEN))
    got = np.array([answers_of(c) for c in codes])
    belief = []
    for name, known in FUNCTIONS:
        right = 40.0 if name == "lines" else 12.0  # it has looked at every line
        speaks = [(None,) if a is None else JUNK_OF[name] if a == "junk" else (a,) for a in known]
        t = np.array([[3.0 if a is None else right if y in for_ else 1.0 for a, for_ in zip(known, speaks)] for y in HIDDEN])
        belief.append(t / t.sum(1, keepdims=True))
    tables, shares = belief, np.array([0.5, 0.125, 0.125, 0.125, 0.125])
    for _ in range(rounds):
        logs = np.log(shares) + sum(np.log(t[:, got[:, f]].T) for f, t in enumerate(tables))
        logs -= logs.max(1, keepdims=True)
        post = np.exp(logs)
        post /= post.sum(1, keepdims=True)
        mass = post * n[:, None]
        shares = (mass.sum(0) + 10.0) / (mass.sum() + 10.0 * len(HIDDEN))
        tables = []
        for f, (_, known) in enumerate(FUNCTIONS):
            t = np.stack([mass[got[:, f] == k].sum(0) for k in range(len(known))], axis=1)
            t = t + weight * belief[f]
            tables.append(t / t.sum(1, keepdims=True))
    merged = np.stack([post[:, [k for k, t in enumerate(TYPE_OF) if t == y]].sum(1) for y in range(len(TYPES))], axis=1)
    return dict(zip(codes, merged)), tables, shares


COMMON_WORDS = 100_000


def common_words(table: DataFrame) -> Common:
    """The frequent words as a set for the workers; the table is fixed at a few hundred rows."""
    held = table.select(F.lower("word").alias("w")).where(F.length(F.trim("w")) > 0).distinct().limit(COMMON_WORDS + 1).collect()
    if len(held) > COMMON_WORDS:
        raise ValueError(f"more than {COMMON_WORDS} common words")
    return Common({r.w for r in held})


def document_statistics(df: DataFrame, key: str, text: str, common: Common) -> DataFrame:
    """doc_id, the statistics (null for a null text), pattern (null for null and blank texts)."""
    kinds = ["long" if c in ("n_words", "n_lines") else "double" for c in COLUMNS]
    schema = "doc_id long, " + ", ".join(f"{c} {k}" for c, k in zip(COLUMNS, kinds)) + ", pattern long"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for key_, t in zip(pdf["doc_id"], pdf["text"]):
                if t is None:
                    rows.append((key_, *[None] * len(COLUMNS), None))
                    continue
                s = statistics(t, common)
                rows.append((key_, *s, pattern(votes(dict(zip(COLUMNS, s)))) if t.strip() else None))
            made = pd.DataFrame(rows, columns=["doc_id", *COLUMNS, "pattern"])
            for c, k in zip(COLUMNS, kinds):
                made[c] = made[c].astype("Int64" if k == "long" else "float64")
            yield made.astype({"doc_id": "Int64", "pattern": "Int64"})

    read = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made = read.mapInPandas(run, schema)
    # missing numbers come back as NaN
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, k in zip(COLUMNS, kinds) if k == "double"})


def typed(stats: DataFrame) -> DataFrame:
    """stats with text_type, and posterior of that type. stats is read twice, so it should be a checkpoint or a table."""
    counts = {r.pattern: r["n"] for r in stats.where("pattern is not null").groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    post, _, _ = learn(counts)
    rows = [(int(c), TYPES[int(p.argmax())], float(p.max())) for c, p in post.items()]
    known = stats.sparkSession.createDataFrame(rows, "pattern long, text_type string, posterior double")
    return stats.join(F.broadcast(known), "pattern", "left").drop("pattern")
