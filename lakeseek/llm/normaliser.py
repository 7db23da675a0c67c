"""The normaliser of a piece model, compiled from its character map into plain rules.

A character map is a double-array trie of UTF-8 keys and a block of zero-ended replacements. Compiling walks the trie
once, level by level, and keeps each key with its replacement: keys of one character become a translation table, longer
ones a dictionary that is asked only where a character stands that is second in some key. At each place the longest key
wins. White space then is stripped and collapsed where the model asks for it, blanks become U+2581, and one is put
in front where the model wants that.
"""

from __future__ import annotations

import re

import numpy as np

SPACE = "▁"


def rules(charsmap: bytes) -> dict[str, str]:
    """Keys and replacements of a character map."""
    if not charsmap:
        return {}
    size = int.from_bytes(charsmap[:4], "little")
    units, strings = np.frombuffer(charsmap[4 : 4 + size], "<u4"), charsmap[4 + size :]

    def base(nodes: np.ndarray) -> np.ndarray:
        u = units[nodes].astype(np.int64)
        return nodes ^ ((u >> 10) << ((u & 512) >> 6))

    found, labels = {}, np.arange(1, 256)
    keys, at = [b""], base(np.zeros(1, np.int64))
    while len(keys):
        child = at[:, None] ^ labels[None, :]
        inside = child < len(units)
        unit = units[np.where(inside, child, 0)]
        row, column = np.nonzero(inside & ((unit & np.uint32(0x800000FF)) == labels[None, :]))
        nodes = child[row, column]
        keys = [keys[r] + bytes([c + 1]) for r, c in zip(row.tolist(), column.tolist())]
        at = base(nodes)
        leaf = (units[nodes] >> 8) & 1 == 1
        for i in np.flatnonzero(leaf).tolist():
            value = int(units[at[i]]) & 0x7FFFFFFF
            found[keys[i].decode("utf-8", "replace")] = strings[value : strings.index(b"\0", value)].decode("utf-8", "replace")
    return found


class Normaliser:
    def __init__(self, charsmap: bytes = b"", collapse: bool = False, prefix: bool = True):
        known = rules(charsmap)
        self.collapse, self.prefix = collapse, prefix
        self.one = {ord(k): v for k, v in known.items() if len(k) == 1}
        self.more = {k: v for k, v in known.items() if len(k) > 1}
        self.longest = max(map(len, self.more), default=0)
        seconds = "".join(sorted({re.escape(k[1]) for k in self.more}))
        self.candidates = re.compile(f"(?s).(?=[{seconds}])") if seconds else None

    def replaced(self, text: str) -> str:
        if self.candidates is None:
            return text.translate(self.one) if self.one else text
        out, at = [], 0
        for m in self.candidates.finditer(text):
            i = m.start()
            if i < at:
                continue
            for n in range(min(self.longest, len(text) - i), 1, -1):
                new = self.more.get(text[i : i + n])
                if new is not None:
                    out += [text[at:i].translate(self.one), new]
                    at = i + n
                    break
        return "".join(out) + text[at:].translate(self.one)

    def __call__(self, text: str) -> str:
        """The text as the piece transducer reads it; empty for an empty text."""
        if not text:
            return ""
        text = self.replaced(text)
        if self.collapse:
            text = re.sub(" +", " ", text).strip(" ")
            if not text:
                return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)
