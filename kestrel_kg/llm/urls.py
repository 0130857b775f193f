"""URL filters: rules of hosts and paths first, else a weighted vocabulary counted by an Aho-Corasick automaton.

A rule names a host and the beginning of a path; it fits the host itself and all its subdomains. Of the rules that fit the longest one
(host and path together) decides, of equally long ones a blocking one. Where none fits, the whole address is searched for the
vocabulary's terms in one pass, whatever their number. A term counts only as a whole word: no ASCII letter or digit and no character beyond
ASCII may stand beside it ("cheap-pills" holds "cheap" and "pills", "cheapskate" neither). Each distinct term adds its weight once; at the
limit the address is blocked, so one strict term (weight: the limit) or several distinct soft ones (weight 1) block it.

Every row is judged by itself: no shuffle, and a task holds the rules, the automaton and one Arrow batch. Only A-Z are lower-cased.

Defined results: a null address, or one without "://", has the empty host and path, so no rule fits it; the vocabulary still judges what
there is (null: allowed). Ports and user names are part of the host. Bytes that aren't UTF-8 count as characters beyond ASCII. Repeated
rows are judged alike, and columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_columns

ALLOW, BLOCK = "allow", "block"
#: Rules and terms are sent to every task, so their number is held to this.
MOST_RULES = 200_000
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

#: Terms that block by themselves, and terms of which two distinct ones do. A deployment passes its own.
STRICT = ("adult", "casino", "cialis", "escort", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx")
SOFT = (
    "ads", "bet", "bets", "betting", "bonus", "cash", "cheap", "crack", "dating", "farm", "free", "hack", "jackpot", "loan", "loans", "lottery", "nude",
    "pharmacy", "pills", "poker", "promo", "sex", "slots", "track", "tracker", "win", "winner",
)
LIMIT = 2


def weights(strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT, limit: int = LIMIT) -> dict[str, int]:
    return dict.fromkeys(soft, 1) | dict.fromkeys(strict, limit)


def split(url: str | None) -> tuple[str, str]:
    """(host, path) of an address."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(UPPER), path


@dataclass(frozen=True)
class Rules:
    """Each host's verdicts by path, and its paths' lengths, longest first: a lookup walks up the host's labels and down these lengths."""

    by_host: dict[str, dict[str, str]] = field(default_factory=dict)
    lengths: dict[str, list[int]] = field(default_factory=dict)

    @staticmethod
    def of(rules: Iterable[tuple[str, str, str]]) -> Rules:
        """From (host, path, verdict)."""
        found: dict[str, dict[str, str]] = {}
        for n, (host, path, verdict) in enumerate(rules):
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"a rule says {ALLOW} or {BLOCK}, not {verdict}")
            if n >= MOST_RULES:
                raise ValueError(f"more than {MOST_RULES} rules")
            paths = found.setdefault(host.translate(UPPER), {})
            paths[path] = BLOCK if BLOCK in (verdict, paths.get(path)) else ALLOW
        return Rules(found, {host: sorted({len(p) for p in paths}, reverse=True) for host, paths in found.items()})

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best: tuple[int, bool, str, str] | None = None
        at = 0
        while host and at >= 0:
            name = host[at:]
            for size in self.lengths.get(name, ()):
                if size <= len(path) and (verdict := self.by_host[name].get(path[:size])):
                    new = (len(name) + size, verdict == BLOCK, name + path[:size], verdict)
                    best = new if best is None else max(best, new)
                    break
            at = host.find(".", at) + 1 or -1
        return best and best[2:]


def automaton(terms: dict[str, int]) -> ahocorasick.Automaton:
    if not terms or len(terms) > MOST_RULES or "" in terms:
        raise ValueError(f"a vocabulary has 1 to {MOST_RULES} terms, none of them empty")
    made = ahocorasick.Automaton()
    for term in terms:
        made.add_word(term.translate(UPPER), term.translate(UPPER))
    made.make_automaton()
    return made


def hits(text: str, made: ahocorasick.Automaton) -> set[str]:
    """The distinct terms that stand in ``text`` as whole words."""
    inside = lambda i: 0 <= i < len(text) and (text[i] in WORD or text[i] >= "\x80")
    return {term for end, term in made.iter(text) if not inside(end + 1) and not inside(end - len(term))}


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = (), terms: dict[str, int] | None = None, *, limit: int = LIMIT, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with host, path, rule (null: none fits), verdict, weight (of the distinct terms) and terms (sorted).

    ``rules``: (host, path, verdict). ``terms``: the weight of each term. ``keep``: the columns passed on (None: all).
    """
    known, terms = Rules.of(rules), {k.translate(UPPER): v for k, v in (weights() if terms is None else terms).items()}
    automaton(terms)  # fails here rather than in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        made = automaton(terms)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("host", "path", "rule", "verdict", "weight", "terms")}
            for raw in b.column(b.schema.get_field_index(url)).cast(pa.binary()).to_pylist():
                text = (raw or b"").decode("utf-8", "replace")
                host, path = split(text)
                fit = known.find(host, path)
                found = sorted(hits(text.translate(UPPER), made))
                weight = sum(terms[t] for t in found)
                verdict = fit[1] if fit else BLOCK if weight >= limit else ALLOW
                for k, v in zip(out, (host, path, fit and fit[0], verdict, weight, found), strict=True):
                    out[k].append(v)
            kinds = {"weight": pa.int64(), "terms": pa.list_(pa.string())}
            yield {k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()}

    return with_columns(pages, run, "host string, path string, rule string, verdict string, weight long, terms array<string>", keep=keep, need=[url])
