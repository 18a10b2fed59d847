"""Exact word-memoised tokenisation with the ``tokenizers`` library.

A byte-pair tokenizer never merges across the piece borders that its
pre-tokenizer sets, so a text may be cut at any place where such a border is
certain. Both supported vocabularies set one at every blank; each distinct
segment between blanks is then encoded once a worker by the library itself and
looked up ever after. No part of the library's rules is rewritten here.
"""

from __future__ import annotations

import os
import re
from array import array

from . import memos

#: A blank next to other white space is no certain border for byte-level
#: patterns, which may hold runs of white space together.
_LONE_BLANK = re.compile(r"(?<!\s) (?!\s)")

#: Within a segment of these characters a border also stands between letters and
#: anything else, for both vocabularies (apostrophes, which may join, are left out,
#: and so are characters that normalising may change in kind).
_PLAIN = "!-&(-~À-ÖØ-öø-ÿ"
_RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[^A-Za-zÀ-ÖØ-öø-ÿ]+")

#: Runs of letters that a worker remembers, at some 200 bytes each.
MEMO_ENTRIES = 800_000
MEMO_CHARS = 64

_loaded: dict[tuple[int, bool], "SegmentEncoder"] = {}
memos.register("tokens", _loaded.clear)


def read_spec(path: str) -> str:
    """The tokenizer file's JSON, to be shipped to the executors as text."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoder_for(spec: str, blanks_join: bool, memo_entries: int = MEMO_ENTRIES) -> "SegmentEncoder":
    """One encoder a worker process, kept for its later tasks."""
    memos.claim("tokens")
    key = (hash(spec), blanks_join)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = SegmentEncoder(spec, blanks_join)
    _loaded[key].memo_entries = memo_entries
    return _loaded[key]


class SegmentEncoder:
    """Encodes segments through the library, remembering short ones.

    ``blanks_join``: True for vocabularies whose tokens hold the blank in front
    of a word (byte-level), False for those that drop white space.
    """

    def __init__(self, spec: str, blanks_join: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.blanks_join = blanks_join
        self.memo_entries = MEMO_ENTRIES
        #: Added tokens are matched before all else: what may begin one is not plain.
        special = "".join({t.content[0] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.simple = re.compile(rf"(?:\n(?!\n)|(?![{re.escape(special)}])[{_PLAIN}])+" if special else rf"(?:\n(?!\n)|[{_PLAIN}])+").fullmatch
        self.memo: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def _raw(self, segments: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _add(self, memo: dict[str, bytes], words: set[str], lead: str) -> None:
        need = list(words.difference(memo))
        if need:
            memo.update(zip(need, self._raw([lead + w for w in need])))

    def lookup(self, words: list[str], certain: bool = True) -> list[bytes] | None:
        """Ids of each word (with its leading blank if blanks join), as uint32 bytes.

        A word that is new is put together from its runs of letters and of other
        characters; only runs that are new go through the library. Unless the cuts are
        ``certain``, a word that is empty or has white space at an end gives None.
        """
        memo = self.memo
        inner = self.first if self.blanks_join else memo
        if len(memo) > self.memo_entries:
            memo.clear()
        if len(inner) > self.memo_entries:
            inner.clear()
        need = set(words).difference(memo)
        if not need:
            return list(map(memo.__getitem__, words))
        simple, find = self.simple, _RUNS.findall
        whole, heads, tails, split, brief = [], set(), set(), [], []
        for w in need:
            if w.strip() != w or not w:
                if not certain:
                    return None
                brief.append(w)  # not to be taken for a certain word later
            elif not w.isalpha() and simple(w):
                runs = find(w)
                if len(runs) > 1:
                    split.append((w, runs))
                    if runs[0] not in memo or "\n" in w:
                        brief.append(w)  # rare: not worth the room
                        heads.add(runs[0])
                    tails.update(runs[1:])
                    continue
            whole.append(w)
            if len(w) > MEMO_CHARS:
                brief.append(w)
        self._add(memo, heads.union(whole), " " if self.blanks_join else "")
        self._add(inner, tails, "")
        for w, runs in split:
            memo[w] = memo[runs[0]] + b"".join(map(inner.__getitem__, runs[1:]))
        out = list(map(memo.__getitem__, words))
        brief += [w for w in heads if len(w) > MEMO_CHARS]
        for w in brief:
            memo.pop(w, None)
        for w in tails:
            if len(w) > MEMO_CHARS:
                inner.pop(w, None)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words = text.split(" ")
        if not self.blanks_join:
            return b"".join(self.lookup(words))
        rest = self.lookup(words[1:], False) if words[0].strip() == words[0] != "" else None
        if rest is None:
            words = _LONE_BLANK.split(text)
            rest = self.lookup(words[1:])
        head = self.first.get(words[0])
        if head is None:
            head = self._raw([words[0]])[0]
            if len(words[0]) <= MEMO_CHARS:
                self.first[words[0]] = head
        return head + b"".join(rest)
