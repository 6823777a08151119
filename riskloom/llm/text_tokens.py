"""Token ids of whole texts, as one byte string of little-endian unsigned 32-bit ids.

The tokenizer folds case, drops white space and never merges across a boundary between
letters and other characters. For texts in Latin-1 it is therefore enough to encode each
distinct piece once and to join what is remembered. Other texts, and those that hold a
special token's string, go through the tokenizer whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "a-zªµºß-öø-ÿ"
#: What stands alone beside letters: words with an apostrophe, and runs of other characters.
ALONE = rf"([^ \t\n\f\r]*'[^ \t\n\f\r]*|[^{LETTERS} \t\n\f\r]+)"
#: Special tokens, and white space that not every tool takes for such.
ODD = re.compile("<\\||[\x0b\x1c-\x1f\x85\xa0]")
#: Characters of text that are encoded at a time, about.
RUN = 4 << 20


class WordTokens:
    """Ids of texts, from the ids of their pieces; ``keep`` bounds what is remembered."""

    def __init__(self, path: str, keep: int = 600_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tool, self.keep = Tokenizer.from_file(path), keep
        # letters that are folded and alone need neither the folding nor the search for boundaries
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.pieces: dict[str, bytes] = {"": b""}
        vocabulary = self.tool.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def plain(self, text: str) -> bytes:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Remember new pieces; letters are encoded together and cut at the word ends."""
        letters = [p for p in new if p.isalpha()]
        if letters:
            found = self.letters.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(letters):
                raw, at = ids.tobytes(), 0
                for p, end in zip(letters, (4 * cut).tolist()):
                    self.pieces[p] = raw[at:end]
                    at = end
        for p in new:
            if p not in self.pieces:
                self.pieces[p] = self.plain(p)

    def run(self, texts: list[str]) -> list[bytes]:
        """The ids of each of some texts in Latin-1."""
        spaced = pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.large_string())), ALONE, r" \1 ")
        lists = pc.ascii_split_whitespace(spaced)
        held = lists.flatten().dictionary_encode()
        kinds, at = held.dictionary.to_pylist(), held.indices.to_numpy()
        found = list(map(self.pieces.get, kinds))
        if None in found:
            if len(self.pieces) > self.keep:
                self.pieces = {"": b""}
                found = [None] * len(kinds)
            self.learn([p for p, i in zip(kinds, found) if i is None and p])
            found = list(map(self.pieces.__getitem__, kinds))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = sizes[at]
        ends = np.cumsum(n)
        places = np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - n), n)
        places += np.arange(len(places))
        ids = np.frombuffer(b"".join(found), "<u4")[places]
        bounds = np.append(0, ends)[lists.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        run: list[tuple[int, str]] = []
        size = 0

        def flush():
            for (i, _), ids in zip(run, self.run([t for _, t in run])):
                out[i].append(ids)
            run.clear()

        for i, text in enumerate(texts):
            if ODD.search(text) or not latin(text):
                out[i].append(self.plain(text))
                continue
            for part in slices(text):
                run.append((i, part))
                size += len(part)
                if size > RUN:
                    flush()
                    size = 0
        if run:
            flush()
        return [b"".join(parts) for parts in out]

    def ids(self, text: str) -> bytes:
        """The ids of one text."""
        return self.many([text])[0]


def slices(text: str) -> list[str]:
    """A text in parts of about ``RUN`` characters, cut at blanks; as long as it takes where there are none."""
    parts, at = [], 0
    while len(text) - at > RUN:
        cut = max(text.rfind(" ", at, at + RUN), text.rfind("\n", at, at + RUN)) + 1
        if not cut:
            later = [p for p in (text.find(" ", at + RUN), text.find("\n", at + RUN)) if p >= 0]
            cut = min(later, default=len(text) - 1) + 1
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True
