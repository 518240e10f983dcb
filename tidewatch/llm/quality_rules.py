"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected.

A line fails when it is a repeat of an earlier line of the document, has no letter, has over a tenth of symbols, reads as navigation (several separators
between short segments), shouts (exclamation marks after most words, or capitals throughout) or holds a stock phrase of web boilerplate. A line
without words carries no text and never counts as lost. A document is kept if it has enough words, does not repeat itself and keeps at least
1 - `max_lost` of its word characters.

Defined cases: a null text counts as empty and has no words; it fails for too few words. Repeated rows are judged one by one; other columns
are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import id_and_bytes, map_batches

SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_SEPARATOR = re.compile(rb"\s(?:\||/|\xc2\xbb|\xe2\x80\xba|\xc2\xb7|>)\s")
_BOILERPLATE = re.compile(rb"\b(?:all rights reserved|privacy policy|terms of (?:use|service)|accept (?:all )?cookies|this site uses cookies|subscribe to our|sign up for our|enable javascript|click here to|skip to (?:main )?content|lorem ipsum|powered by|back to top|share on (?:facebook|twitter))\b", re.I)


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.translate(None, _CONTINUATION))


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """Whether one line that has words breaks a rule by itself."""
    joined = b"".join(words)
    if not _LETTER.search(joined):
        return True
    if 10 * (len(joined) - len(joined.translate(None, SYMBOLS + b"{}~^=_\\"))) > len(joined):
        return True
    if len(_SEPARATOR.findall(line)) >= 3:
        return True
    if len(words) >= 4 and 2 * line.count(b"!") > len(words):
        return True
    if len(words) >= 8 and joined.upper() == joined and joined.lower() != joined:
        return True
    return _BOILERPLATE.search(line) is not None


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """How many words stand in windows of `width` words that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = [known.setdefault(w, len(known)) for w in words]
    if len(known) == n:
        return 0
    if len(known) ** width < 2**62:
        a = np.array(ids, dtype=np.int64)
        key = a[: n - width + 1].copy()
        for k in range(1, width):
            key = key * len(known) + a[k : n - width + 1 + k]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    else:
        seen: dict[tuple, int] = {}
        keys = list(zip(*(ids[k:] for k in range(width))))
        for k in keys:
            seen[k] = seen.get(k, 0) + 1
        twice = np.array([seen[k] > 1 for k in keys])
    hit = np.zeros(n, dtype=bool)
    for k in range(width):
        hit[k : n - width + 1 + k] |= twice
    return int(hit.sum())


def judge(text: bytes | None, *, min_words: int, max_repeat: int, max_lost: float, with_text: bool) -> tuple:
    text = text or b""
    words = text.split()
    lines, lost, n_dup, seen, stays = text.split(b"\n"), 0, 0, set(), []
    total = code_points(b"".join(words))
    for line in lines:
        own = line.split()
        if own and line in seen:
            n_dup += 1
        if own and (line in seen or line_fails(line, own)):
            lost += code_points(b"".join(own))
        elif with_text:
            stays.append(line)
        if own:
            seen.add(line)
    n_repeat = repeated_words(words)
    failed = len(words) < min_words or 100 * n_repeat > max_repeat * len(words)
    kept = not failed and lost <= max_lost * total
    out = (len(words), total, len(text) - len(text.translate(None, SYMBOLS)), n_dup, n_repeat, failed, kept, len(lines) - len(stays) if with_text else None, b"\n".join(stays).decode() if with_text else None)
    return out


_BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def clean(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: int = 50, max_lost: float = 0.3, with_text: bool = True) -> DataFrame:
    """One row for each document: its counts, the verdict and, with_text, how many lines went and the text that stays."""
    names = [*(x.split()[0] for x in _BASE.split(", ")), *(["lines_removed", "text"] if with_text else [])]

    def batch(b: pa.RecordBatch) -> dict[str, list]:
        rows = [judge(cell.as_py(), min_words=min_words, max_repeat=max_repeat, max_lost=max_lost, with_text=with_text) for cell in b.column("text")]
        by_column = list(zip(*rows)) if rows else [[]] * 9
        return dict(zip(names, [b.column("doc_id"), *by_column]))

    return map_batches(id_and_bytes(documents, id_col, text_col), batch, _BASE + (", lines_removed long, text string" if with_text else ""))
