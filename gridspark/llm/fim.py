"""Fill-in-the-middle: texts cut at two unit boundaries and put together in another order.

A unit is a word with the white space before it; white space at the end of a text is a unit too.  A byte automaton,
run as table lookups over many blocks of text in step, tells continuation bytes, ends of units and marks apart.  The
one scan counts per block what its transitions emit; a second pass runs again through the blocks alone in which a
cut lies, and finds the cut's byte and code point there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import SPACE, arrow_map, binary_view, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that the automaton takes in one block; all blocks of a slice advance together.
BLOCK = 256
_OTHER, _SPACE, _OPEN, _LETTER, _CLOSE, _CONTINUED, _BEYOND = range(7)
_GAP, _WORD, _OPENED, _NAMED = range(4)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each byte; the next state and what is emitted (code point, unit's end, mark) by state * 8 + class."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[0x80:0xC0] = _CONTINUED
    kind[SPACE] = _SPACE
    kind[ord("<")], kind[ord(">")] = _OPEN, _CLOSE
    kind[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = _LETTER
    step, emitted = np.zeros(32, np.uint8), np.zeros((32, 3), np.int32)
    for state in range(4):
        for c in range(7):
            at = state * 8 + c
            step[at] = {_SPACE: _GAP, _OPEN: _OPENED, _BEYOND: state, _LETTER: _NAMED if state == _OPENED else _WORD}.get(c, _WORD)
            emitted[at] = c not in (_CONTINUED, _BEYOND), state != _GAP and c == _SPACE, state == _NAMED and c == _CLOSE
    return kind, step, emitted


_KIND, _NEXT, _EMITTED = _tables()
#: The three counts of a block in one number.
_PACKED = (_EMITTED * np.array([1, 1 << 10, 1 << 20], np.int32)).sum(1, dtype=np.int32)


class Scan:
    """Units, code points and marks of the texts whose bytes are data[at[0]] to data[at[-1]], and where units end."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        self.size, base = np.diff(at), at[0]
        self.kinds = np.append(_KIND[data[base : at[-1]]], np.uint8(_BEYOND))
        at = at - base
        blocks = -(-self.size // BLOCK)
        row = np.repeat(np.arange(len(self.size)), blocks)
        self.first = np.append(0, np.cumsum(blocks))
        self.begin = at[row] + (np.arange(len(row)) - self.first[row]) * BLOCK
        self.end, self.text = np.minimum(self.begin + BLOCK, at[row + 1]), at[:-1]
        # two bytes are all that a state remembers, so a block starts with those before it
        state = np.zeros(len(row), np.uint8)
        for back in (2, 1):
            before = self.begin - back >= at[row]
            state = np.where(before, _NEXT[state * 8 + self.kinds[np.maximum(self.begin - back, 0)]], state)
        self.state, counts = state, np.zeros(len(row), np.int32)
        for k in range(BLOCK if len(row) else 0):
            code = self._code(state, self.begin, self.end, k)
            counts += _PACKED[code]
            state = _NEXT[code]
        each = np.stack([counts & 1023, counts >> 10 & 1023, counts >> 20]).astype(np.int64)
        self.sums = np.concatenate([np.zeros((3, 1), np.int64), each.cumsum(1)], axis=1)
        self.chars, ends, self.marks = self.sums[:, self.first[1:]] - self.sums[:, self.first[:-1]]
        self.units = ends + (self.size > 0)

    def _code(self, state: np.ndarray, begin: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        at = begin + k
        return state * np.uint8(8) + self.kinds[np.where(at < end, at, len(self.kinds) - 1)]

    def cuts(self, rows: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and code points of the given texts before the end of so many units."""
        byte = np.where(units >= self.units[rows], self.size[rows], 0)
        char = np.where(units >= self.units[rows], self.chars[rows], 0)
        inner = np.flatnonzero((units > 0) & (units < self.units[rows]))
        wanted = self.sums[1, self.first[rows[inner]]] + units[inner]
        block = np.searchsorted(self.sums[1], wanted) - 1
        begin, end, state = self.begin[block], self.end[block], self.state[block]
        need = (wanted - self.sums[1, block]).astype(np.int32)
        chars, seen, found = np.zeros(len(inner), np.int64), np.zeros(len(inner), np.int32), np.zeros((2, len(inner)), np.int64)
        for k in range(BLOCK if len(inner) else 0):
            code = self._code(state, begin, end, k)
            lead, ended, _ = _EMITTED[code].T
            seen += ended
            here = (ended > 0) & (seen == need)
            found[0, here] = k
            found[1, here] = chars[here]
            chars += lead
            state = _NEXT[code]
        byte[inner] = begin + found[0] - self.text[rows[inner]]
        char[inner] = self.sums[0, block] - self.sums[0, self.first[rows[inner]]] + found[1]
        return byte, char


def _draws(seed: int) -> list[Column]:
    """Four numbers from the id and the seed; a null id draws as if it had no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def rearrange(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row.

    n counts units.  Of all texts ``rate`` in a hundred are rearranged, of those ``suffix_first`` in a hundred as spm
    (suffix, prefix, middle), the others as psm; the rest, empty texts and those that hold a mark already are plain:
    output is the text and there are no counts.  A null text is empty.  What is drawn depends on id and seed alone,
    so repeated rows have equal results; an empty table gives no rows; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        data, at = binary_view(batch.column(1))
        draws = [batch.column(2 + k).to_numpy() for k in range(4)]
        out: dict[str, list] = {c: [] for c in ("n", "form", "prefix_chars", "middle_chars", "output")}
        for lo, hi in slices(at):
            scan = Scan(data, at[lo : hi + 1])
            h1, h2, h3, h4 = (d[lo:hi] for d in draws)
            form = np.where((scan.size == 0) | (scan.marks > 0) | (h3 % 100 >= rate), "plain", np.where(h4 % 100 < suffix_first, "spm", "psm"))
            rows = np.flatnonzero(form != "plain")
            a, b = (h[rows] % (scan.units[rows] + 1) for h in (h1, h2))
            byte, char = scan.cuts(np.tile(rows, 2), np.concatenate([np.minimum(a, b), np.maximum(a, b)]))
            cut = {r: (*byte[[k, k + len(rows)]].tolist(), *char[[k, k + len(rows)]].tolist()) for k, r in enumerate(rows.tolist())}
            for r in range(hi - lo):
                text = data[at[lo + r] : at[lo + r + 1]].tobytes()
                if r not in cut:
                    counts = None, None
                else:
                    x, y, cx, cy = cut[r]
                    counts = cx, cy - cx
                    first = (PREFIX.encode(), text[:x]), (SUFFIX.encode(), text[y:])
                    text = b"".join(part for pair in (first if form[r] == "psm" else first[::-1]) for part in pair) + MIDDLE.encode() + text[x:y]
                out["prefix_chars"].append(counts[0])
                out["middle_chars"].append(counts[1])
                out["output"].append(text)
            out["n"] += scan.units.tolist()
            out["form"] += form.tolist()
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        return {"doc_id": batch.column(0)} | {c: pa.array(out[c], t) for c, t in zip(out, types, strict=False)} | {"output": pa.array(out["output"], pa.binary()).cast(pa.string())}

    rows = docs.select("doc_id", "text", *_draws(seed))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that rearrange() made the output of; marks cannot overlap with what stands beside them."""
    part = lambda k: F.get(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """rearrange() with checksums of output and of the text made of it again."""
    out = rearrange(docs)
    again = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


ORACLE = """
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS t, sha256('42:' || doc_id) AS h FROM documents),
c AS (SELECT *, len(t) AS n, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
