"""URL rules and wildcard patterns by a bit-parallel automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table

#: Stands between host and path in what the automaton reads; no character of a url is taken for it.
BOUNDARY = 0x110000
#: Cells of a padded block of urls that is simulated at once.
BLOCK_CELLS = 1 << 22

#: (verdict, host, path): each fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Wildcard block list over host and path: ``*`` any run of characters, ``?`` any one; ``^`` the host's end.
BLOCK_GLOBS = (
    "*spam-farm.*^*", "*casino-win.*^*", "*cheap-pills.*^*", "*ads-track.*^*", "*free-bets.*^*", "*adult-x.*^*",
    "*^/ads/*", "*^*/out?url=*", "*^*.exe",
)


class WildcardAutomaton:
    """All patterns in one multiword Shift-And: each has a bit for every place between its characters.

    On a character c the state D becomes ((D << 1) & accepts[c]) | (D & loops), where ``loops`` has the places at
    which a ``*`` stands. A pattern matches if its last place is set at the end.
    """

    def __init__(self, patterns: Sequence[Sequence[int | str]]):
        """A pattern is a sequence of code points, ``"*"`` and ``"?"``."""
        chars = sorted({t for p in patterns for t in p if not isinstance(t, str)})
        self.alphabet = np.array(chars or [0], dtype=np.uint32)
        places = [1 + sum(t != "*" for t in p) for p in patterns]
        self.words = max(1, -(-sum(places) // 64))
        accepts = np.zeros((len(self.alphabet) + 1, self.words), dtype=np.uint64)  # the last: any other character
        self.start, self.loops = (np.zeros(self.words, dtype=np.uint64) for _ in range(2))
        self.ends: list[tuple[int, np.uint64]] = []

        def bit(i: int) -> tuple[int, np.uint64]:
            return i // 64, np.uint64(1 << (i % 64))

        at = 0
        for pattern in patterns:
            word, mask = bit(at)
            self.start[word] |= mask
            for token in pattern:
                if token == "*":
                    word, mask = bit(at)
                    self.loops[word] |= mask
                    continue
                at += 1
                word, mask = bit(at)
                if token == "?":
                    accepts[:, word] |= mask
                else:
                    accepts[np.searchsorted(self.alphabet, token), word] |= mask
            self.ends.append(bit(at))
            at += 1
        self.accepts = accepts

    def classes(self, codes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[place] == codes, place, len(self.alphabet)).astype(np.uint16)

    def run(self, texts: list[np.ndarray]) -> np.ndarray:
        """A boolean row per text, a column per pattern."""
        out = np.zeros((len(texts), len(self.ends)), dtype=bool)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            longest = max(1, int(lengths[order[at]]))
            block = order[at : at + max(1, BLOCK_CELLS // longest)]
            at += len(block)
            cells = np.zeros((longest, len(block)), dtype=np.uint16)
            for column, i in enumerate(block.tolist()):
                cells[: lengths[i], column] = self.classes(texts[i])
            alive = np.searchsorted(-lengths[block], -np.arange(longest), side="left")  # longer than each step
            state = np.repeat(self.start[None, :], len(block), axis=0)
            for step in range(longest):
                n = int(alive[step])
                now = state[:n]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[:n] = (moved & self.accepts[cells[step, :n]]) | (now & self.loops)
            for p, (word, mask) in enumerate(self.ends):
                out[block, p] = (state[:, word] & mask) != 0
        return out


def glob_tokens(glob: str) -> list[int | str]:
    return [c if c in "*?" else BOUNDARY if c == "^" else ord(c) for c in glob]


def rule_tokens(host: str, path: str) -> list[int | str]:
    """A dot stands before every host, so one pattern fits the host and its subdomains."""
    return ["*", *map(ord, "." + host), BOUNDARY, *map(ord, path), "*"]


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` with ``host`` and ``path``; both empty for a null url and one without ``://``."""
    url = F.col(f"`{url_col}`")
    after = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    after = F.coalesce(after, F.lit(""))
    raw = F.regexp_extract(after, r"^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return df.withColumns({
        "host": F.translate(raw, upper, upper.lower()), "path": F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    })


def judge_urls(df: DataFrame, id_col: str, url_col: str, rules=RULES, globs=BLOCK_GLOBS) -> DataFrame:
    """(id, host, path, rule, verdict) of every row: the longest fitting rule decides, else the block list.

    A null url and one without a scheme fit no rule and are allowed. Urls of any length are read whole. Rows are
    judged one by one, so ties, repeated rows and hot hosts need no care. Other columns are not read.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    names = [host + path for _, host, path in ordered]
    verdicts = [verdict for verdict, _, _ in ordered]
    patterns = [rule_tokens(host, path) for _, host, path in ordered] + [glob_tokens(g) for g in globs]

    def simulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = WildcardAutomaton(patterns)
        edge = np.array([BOUNDARY], dtype=np.uint32)

        def codes(text: str) -> np.ndarray:
            return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")

        for batch in batches:
            hosts, paths = (batch.column(k).to_pylist() for k in (1, 2))
            texts = [np.concatenate([codes("." + h), edge, codes(p)]) for h, p in zip(hosts, paths, strict=True)]
            fits = automaton.run(texts)
            of_rule = fits[:, : len(names)]
            ruled = of_rule.any(axis=1)
            best = of_rule.argmax(axis=1) if names else np.zeros(len(texts), int)
            globbed = fits[:, len(names) :].any(axis=1)
            rule = [names[b] if r else None for b, r in zip(best, ruled, strict=True)]
            verdict = [
                verdicts[b] if r else ("block" if g else "allow") for b, r, g in zip(best, ruled, globbed, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    lean = split_url(df.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`")), url_col).select(id_col, "host", "path")
    kind = lean.schema[0].dataType.simpleString()
    return lean.mapInArrow(simulate, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def op7_wildcard_url_filter(spark, sf_dir):
    return judge_urls(read_table(spark, sf_dir, "pages"), "page_id", "url")


def _like(glob: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\x01" if c == "^" else "\\" + c
                         if not c.isalnum() else c for c in glob) + "$"


OP7_SQL = """
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS t FROM pages
), b AS (
  SELECT page_id, t, regexp_extract(coalesce(t, ''), '^[^/?#]*') AS h FROM a
), c AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(coalesce(t, ''), length(h) + 1), '^[^?#]*') AS path FROM b
), d AS (
  SELECT *, CASE %s END AS rule FROM c
)
SELECT page_id, host, path, rule,
       CASE %s WHEN %s THEN 'block' ELSE 'allow' END AS verdict
FROM d
""" % (
    " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    ),
    " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in RULES),
    " OR ".join(f"regexp_matches('.' || host || chr(1) || path, '{_like(g)}', 's')" for g in BLOCK_GLOBS),
)
