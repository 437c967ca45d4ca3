"""Per-document text statistics that tell natural prose from lists, tables, dumps and junk."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.session import spread


@dataclass(frozen=True)
class QualityRules:
    """Fixed thresholds. The first group is published for whole texts (rules for web text), the second holds for units."""

    mean_word_length: tuple[float, float] = (3.0, 10.0)
    symbol_ratio: float = 0.1
    bullet_lines: float = 0.9
    punctuated_lines: float = 0.12
    stop_words: int = 2  # in a text, and in the units that hold most of it
    # units: stretches of a line between hard separators
    most_symbols: float = 0.25  # of the characters without white space
    unit_tokens: int = 6  # shorter units are items, unless they go on with a sentence
    unit_words: float = 0.5  # of a unit's tokens that are words
    unit_common: float = 0.12  # of a unit's words that are common
    block_common: float = 0.15  # of a sentence's words so far, for the next line to go on with it
    short_common: float = 0.3  # for short units that begin and end as sentences do
    short_words: float = 0.75
    list_tokens: float = 5.0  # mean tokens between the commas of a list
    misused_articles: float = 0.08  # of the articles that stand before another function word
    least_prose: float = 0.5  # of the characters


#: Articles, and the function words that don't follow an article within a phrase.
ARTICLES = {
    "en": "the a an our its their".split(),
    "de": "der die das den dem des ein eine einem einer".split(),
    "es": "el la los las un una del al".split(),
}
NEVER_AFTER_ARTICLE = {
    "en": (
        "the of and to in a is it that was for on with as we but not this be by at are from or an have which they so if "
        "when has no than its were been there their you our had i"
    ).split(),
    "de": "der die und von das mit des auf ist im dem eine als es aus er hat dass sie nach wird bei sind wie war haben oder aber".split(),
    "es": "de la que el en y a los se del las un por con una su para es al lo como pero sus le ha me si sin sobre este ya entre".split(),
}

_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_LINES = re.compile(r"\r\n|[\n\r\v\f\x85\u2028\u2029]")
_CELLS = re.compile(r"[|│¦]|\t+|\s•\s| {4,}")
_BORDERS = ("|", "│", "¦", "\t", "•", "    ")
_BULLET = re.compile(r"\s*(?:[-*+•‣◦·▪–—]\s|\(?\d{1,3}[.)]\s|\(?[a-zA-Z][.)]\s|\[[ xX]\]\s)")
_QUOTE = re.compile(r"\s*(?:>\s*|#{1,6}\s+)")
_PARTS = re.compile(r"[,;，、]\s+")
_INNER = re.compile(r"\w")
_MARKS = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\Z")
_WIDE = re.compile(r"[\u3040-ヿ㐀-䶿一-鿿가-\ud7af\u0e00-\u0e7f]")
#: Lines of code, settings and call stacks: how they begin, the operators in them, how they end.
_CODE = re.compile(
    r"""\s*(?:File\s+["'“].*,\s*line\s+\d+|at\s+[\w.$<>]+\(.*\)|(?:export\s+)?[A-Z_]{3,}=|--\w|[\[{(]?\s*"[\w ]+"\s*:)""", re.I
)
_OPERATORS = ("==", "!=", "+=", "=>", "&&")
_STATEMENT = re.compile(
    r"\s*(?:for|FOR|if|IF|elif|ELIF|while|WHILE|with|WITH|def|DEF|class|CLASS)\b(?=.*[_=<>()\[\].]).*:"
    r"\s*(?:(?:return|RETURN|pass|PASS|continue|CONTINUE|break|BREAK|raise|RAISE)\b.*)?$"
)
_CALL = re.compile(r"[\w\])]\):\Z")
_CLOSERS = "'\"”’»)]*_`"
_STOPS = frozenset(".!?…。！？")
_ENDS = _STOPS | frozenset(":;；：")


def _last(stripped: str) -> str:
    """The last character of a text before closing marks."""
    return stripped.rstrip(_CLOSERS)[-1:]


def _is_code(line: str, stripped: str) -> bool:
    return (
        _CODE.match(line) is not None
        or any(x in line for x in _OPERATORS)
        or stripped.endswith(("{", "}"))
        or (stripped.endswith(";") and stripped[:-1].rstrip().endswith(")"))
        or (stripped.endswith(":") and (_CALL.search(stripped) is not None or _STATEMENT.match(line) is not None))
        or _STATEMENT.match(line) is not None
    )


class Tokens:
    """Properties of tokens by number; each different token is looked at once per task, within a bounded memory."""

    def __init__(self, common: frozenset[str], remember: int = 200_000) -> None:
        self.common, self.remember = common, remember
        self.articles = [frozenset(ARTICLES[k]) for k in ARTICLES]
        self.never = [frozenset(NEVER_AFTER_ARTICLE[k]) for k in ARTICLES]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.empty((0, 8), np.int64)

    def _properties(self, x: str) -> tuple[int, ...]:
        """Length, inner characters, wide ones, word, common, letters of the word, bits of its roles, closing mark."""
        bare, word = x.lower(), x.isalpha()
        if not word:
            first = _INNER.search(x)
            bare = bare[first.start() : len(x) - _INNER.search(x[::-1]).start()] if first and len(bare) == len(x) else bare
            bare = bare if first else ""
            word = _WORD.match(bare) is not None
        roles = 0
        for k, (articles, never) in enumerate(zip(self.articles, self.never)):
            roles |= (bare in articles) << (2 * k) | (bare in never) << (2 * k + 1)
        inner = len(x) if x.isalnum() else len(_MARKS.sub("", x))
        wide = 0 if x.isascii() else len(_WIDE.findall(x))
        return len(x), inner, wide, word, word and bare in self.common, len(bare) if word else 0, roles, x[-1:] in ".,;:!?"

    def numbers(self, units: list[list[str]]) -> np.ndarray:
        """The number of each token of the units, one after the other."""
        if len(self.known) > self.remember:
            self._forget()
        new = list(set().union(*units) - self.known.keys())
        if new:
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, np.array([self._properties(x) for x in new], np.int64)])
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(units)), np.int64, sum(map(len, units)))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of successive stretches of ``values``."""
    ends = np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])]
    return np.diff(ends)


class Judge:
    """Statistics and verdicts of a batch of texts, as columns; made once per task."""

    def __init__(self, common: dict[str, list[str]], rules: QualityRules) -> None:
        self.rules = rules
        self.tokens = Tokens(frozenset().union(*common.values()) if common else frozenset())

    def _units(self, line: str) -> list[str]:
        """Stretches of a line between cell borders, or between the commas or semicolons of a list."""
        r = self.rules
        cells = [c for c in _CELLS.split(line) if c.strip()] if any(x in line for x in _BORDERS) else [line]
        out = []
        for c in cells:
            parts = _PARTS.split(c)
            if len(parts) >= 3:
                # a list has short parts throughout; sentences have long ones
                sizes = [len(p.split()) for p in parts]
                if len(c.split()) / len(parts) <= r.list_tokens and sum(n > r.unit_tokens for n in sizes) <= 0.2 * len(parts):
                    out += parts
                    continue
            out.append(c)
        return out

    def __call__(self, texts: list[str | None]) -> pd.DataFrame:
        r = self.rules
        # lines and their units; what is told by patterns is told here, all else by sums over columns
        doc_lines, lines, units, words = [], [], [], []
        for d, text in enumerate(texts):
            clean = _HIDDEN.sub("", html.unescape(text)) if text and _HIDDEN.sub("", text).strip() else ""
            kept = 0
            for line in _LINES.split(clean):
                stripped = line.rstrip()
                if not stripped:  # may stand within a sentence, where a text is spaced out
                    continue
                kept += 1
                bullet = _BULLET.match(line)
                body = line[bullet.end() :] if bullet else line
                quote = _QUOTE.match(body)
                body = body[quote.end() :] if quote else body
                own = self._units(body)
                heading = quote is not None and "#" in quote[0]  # counts neither way
                lines.append((d, _last(stripped) in _ENDS, bullet is not None, _is_code(line, stripped), heading, len(own)))
                for unit in own:
                    end = unit.rstrip()
                    stop = _last(end) in _STOPS
                    # short sentences: begin and end as such, alone on their line
                    whole = stop and len(own) == 1 and unit.lstrip()[:1].isupper() and not unit.isupper()
                    units.append((stop, stop or end.endswith(":"), whole))
                    words.append(unit.split())
            doc_lines.append(kept)
        n = len(texts)
        line = np.array(lines, np.int64).reshape(-1, 6)
        unit = np.array(units, bool).reshape(-1, 3)
        per_line, per_doc = line[:, 5], np.array(doc_lines, np.int64)
        of_line = np.repeat(np.arange(len(line)), per_line)
        doc = line[of_line, 0]
        bullet, code, heading = (line[of_line, k].astype(bool) for k in (2, 3, 4))
        stop, stops, whole = unit.T
        t = np.fromiter(map(len, words), np.int64, len(words))
        number = self.tokens.numbers(words)
        size, inner, wide, w, found, letters = (_sums(self.tokens.table[number, k], t) for k in range(6))

        # the rules, unit by unit
        first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, bool)
        stopped = np.where(first, True, np.concatenate([[True], stops[:-1]])) if len(doc) else first
        begin = np.maximum.accumulate(np.where(stopped | bullet, np.arange(len(doc)), 0)) if len(doc) else doc
        since = lambda x: np.cumsum(x) - np.concatenate([[0], np.cumsum(x)])[begin]
        on = ~stopped & ~bullet & (since(found) >= r.block_common * since(w))
        many_wide = (wide >= 4) & ((wide >= 0.3 * size) | stop)
        rule = {
            "code": code,
            "symbols": (size - inner > r.most_symbols * size + 2) & ~many_wide,
            "few_tokens": (t < r.unit_tokens) & ~many_wide,
            "few_words": (w < r.unit_words * t) & ~many_wide,
            "few_common_words": (found < np.maximum(1 + (w > 8), r.unit_common * w)) & ~many_wide,
        }
        alone = ~(rule["code"] | rule["symbols"] | rule["few_tokens"] | rule["few_words"] | rule["few_common_words"])
        # a line may go on with the sentence before: wrapped lines lack common words, their ends are short
        goes = on & ~many_wide & ~code & ~rule["symbols"] & np.where(t >= r.unit_tokens, ~rule["few_words"], (w >= 1) | stop)
        good = alone
        if len(doc):
            place = np.arange(len(doc))
            last_alone = np.maximum.accumulate(np.where(alone, place, -1))
            last_break = np.maximum.accumulate(np.where(goes & ~alone, -1, place))
            good = alone | (goes & (last_alone >= last_break))
        short = ~good & (t < r.unit_tokens) & whole & (w > 0) & ~bullet & ~code & ~rule["symbols"] & ~many_wide

        def per_text(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, weights=x, minlength=n)[:n] if len(doc) else np.zeros(n)

        counted = np.where(heading, 0, size)
        total = per_text(counted)
        prose = per_text(counted * good)
        s_words, s_tokens, s_common = per_text(w * short), per_text(t * short), per_text(found * short)
        fine = (s_tokens > 0) & (s_common >= r.short_common * s_words) & (s_words >= r.short_words * s_tokens)
        prose += np.where(fine, per_text(size * short), 0)
        salad = self._salad(number, np.repeat(good, t), np.repeat(doc, t), n)
        n_words, visible = per_text(w), per_text(size)
        ended, bullets = (np.bincount(line[:, 0], weights=line[:, k], minlength=n)[:n] for k in (1, 2))
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.where(salad, 0.0, prose / np.maximum(1, total))
            out = pd.DataFrame(
                {
                    "n_words": n_words.astype(np.int64),
                    "mean_word_length": np.where(n_words > 0, per_text(letters) / n_words, 0.0),
                    "symbol_ratio": (visible - per_text(inner)) / np.maximum(1, visible),
                    "punctuated_lines": ended / np.maximum(1, per_doc),
                    "bullet_lines": bullets / np.maximum(1, per_doc),
                    "common_share": np.where(n_words > 0, per_text(found) / n_words, 0.0),
                    "prose_share": share,
                }
            )
        # published rules: each failure is recorded
        wide_text = per_text(wide) >= 0.3 * visible  # has no white space between words
        low, high = r.mean_word_length
        bare = per_text(counted * ((found < r.stop_words) & ~many_wide)) > 0.5 * total
        failed = {
            "word_length": (n_words > 0) & ~out["mean_word_length"].between(low, high).to_numpy() & ~wide_text,
            "symbol_ratio": (out["symbol_ratio"] > r.symbol_ratio).to_numpy(),
            "bullet_lines": (out["bullet_lines"] > r.bullet_lines).to_numpy(),
            "punctuated_lines": (out["punctuated_lines"] < r.punctuated_lines).to_numpy(),
            "stop_words": (per_text(found) < r.stop_words) & ~wide_text,
            "stop_words_in_parts": bare,
            "word_order": salad,
        }
        fails = np.array(list(failed.values())).T
        # the exact check: most characters of a text that fails lie outside sentences, and why
        prose = ~fails.any(1) | (share >= r.least_prose)
        lost = counted * ~(good | (short & fine[doc])) if len(doc) else counted
        lost_all = per_text(lost)
        breaks = np.array([per_text(lost * v) > 0.5 * lost_all for v in rule.values()]).T
        names, parts = np.array(list(failed), object), np.array([f"no_sentences:{k}" for k in rule], object)
        blank = per_doc == 0
        out["is_prose"] = prose
        out["failed_rules"] = [["blank"] if e else names[f].tolist() for f, e in zip(fails, blank)]
        out["reasons"] = [
            ["blank"] if e else [] if ok else [*names[f], *parts[x]] for f, x, ok, e in zip(fails, breaks, prose, blank)
        ]
        out["is_prose"] = out["is_prose"].astype("boolean")
        for c in ("mean_word_length", "symbol_ratio", "punctuated_lines", "bullet_lines", "common_share", "prose_share", "is_prose"):
            out[c] = out[c].mask(blank)
        return out

    def _salad(self, number: np.ndarray, good: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Texts of shuffled words: articles of their language stand before function words."""
        kept = number[good]
        roles, ends, doc = self.tokens.table[kept, 6], self.tokens.table[kept, 7], doc[good]
        same = doc[1:] == doc[:-1]
        most, wrong = np.zeros(n), np.zeros(n)
        for k in range(len(self.tokens.articles)):
            article = ((roles[:-1] >> (2 * k)) & 1 > 0) & (ends[:-1] == 0) & same
            misused = article & ((roles[1:] >> (2 * k + 1)) & 1 > 0)
            a, m = (np.bincount(doc[:-1], weights=x, minlength=n)[:n] for x in (article, misused))
            more = (a > most) | ((a == most) & (m > wrong))
            most, wrong = np.where(more, a, most), np.where(more, m, wrong)
        return (wrong >= 1) & (wrong >= self.rules.misused_articles * most)


_STATS = (
    "n_words bigint, mean_word_length double, symbol_ratio double, punctuated_lines double, "
    "bullet_lines double, common_share double, prose_share double, is_prose boolean, failed_rules array<string>, "
    "reasons array<string>"
)


def text_quality(
    df: DataFrame,
    common_words: dict[str, list[str]],
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    rules: QualityRules = QualityRules(),
    batch: int = 512,
) -> DataFrame:
    """Statistics of each text, whether it is prose, and why not: one row per row.

    * n_words, mean_word_length: words are runs of letters between white space;
    * symbol_ratio: share of visible characters that are no letters or digits;
    * punctuated_lines, bullet_lines: shares of the non-blank lines;
    * common_share: share of words in ``common_words`` (language -> words);
    * prose_share: share of visible characters in running sentences;
    * failed_rules: the published rules that the text breaks, whatever the verdict;
    * is_prose: false for a text that breaks one of these and holds less than
      ``least_prose`` of its characters in sentences;
    * reasons: for texts that are no prose, the rules that failed, and
      ``no_sentences:<rule>`` for what most of the characters outside
      sentences lack.

    A null, empty or blank text has 0 words, null for all else and the reason
    ``blank``. White space, line ends, invisible characters and entities are
    read as what they stand for. Whole texts are read, however long. Columns
    other than ``keep`` and ``text`` are dropped, so none can clash.

    Method: the statistics are sums over columns of tokens, units (stretches
    of lines between cell borders) and lines of a whole batch of texts. The
    published fixed thresholds for web text are held against them, and against
    the units for stop words; each failure is recorded. As these rules also
    fail for much prose (short lines, headings, other languages), a text that
    fails is then checked exactly: units that hold enough tokens, words and
    common words and few symbols, or go on with the sentence before, are
    sentences, and their characters are counted. Words in shuffled order are
    told by articles before function words.
    """
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep) + _STATS

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(common_words, rules)
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch].reset_index(drop=True)
                out = judge([t if isinstance(t, str) else None for t in part[text].tolist()])
                yield pd.concat([part[list(keep)], out], axis=1)

    return spread(df.select(*keep, F.col(text))).mapInPandas(body, schema)


def word_list(common_words: DataFrame, most: int = 100_000) -> dict[str, list[str]]:
    """The word list as a dictionary for ``text_quality``; it has to be small (``most`` rows)."""
    rows = common_words.select("lang", F.lower("word").alias("word")).dropna().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the word list has more than {most} rows")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["word"])
    return out
