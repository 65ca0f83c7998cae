"""Token ids of whole texts by a public tokenizer, with a cache of runs between ASCII white space.

The word tokenizer drops white space and never joins across it: its normalizer
and its splits look at one run at a time, and no run of an added token holds
white space.  The ids of a text are therefore the ids of its runs, one after
another, and frequent runs need be encoded only once.
"""

from __future__ import annotations

import os
import struct
import sys
import types

WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _tokenizer(path: str):
    """The tokenizer of a file, which this Python process reads once for all of its tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    kept = sys.modules.setdefault("_notes_engine_tokenizers", types.ModuleType("_notes_engine_tokenizers")).__dict__
    if path not in kept:
        kept[path] = Tokenizer.from_file(path)
    return kept[path]


class RunIds(dict):
    """Ids of texts as little-endian unsigned 32-bit integers; bounded memory.

    Maps a run to its ids.  A run of letters with ASCII punctuation after it is
    split there, as the tokenizer splits it, and A-Z of the letters are put in
    lower case, as the tokenizer does; other runs are encoded as they are.
    """

    def __init__(self, path: str, entries: int = 400_000):
        self.tok, self.entries = _tokenizer(path), entries
        self.model = self.tok.model
        self.young, self.old = {}, {}  # ids of runs without punctuation, lately met and before

    def _core(self, core: bytes) -> bytes:
        got = self.young.get(core)
        if got is None:
            got = self.old.get(core)
            if got is None:
                if core.isalpha():  # letters a-z alone: one piece, which neither the normalizer nor the splits change
                    ids = [t.id for t in self.model.tokenize(core.decode())]
                else:
                    ids = self.tok.encode(core.decode("utf-8", "replace"), add_special_tokens=False).ids
                got = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.young) >= self.entries:
                self.young, self.old = {}, self.young
            self.young[core] = got
        return got

    def __missing__(self, run: bytes) -> bytes:
        core = run.rstrip(b".,!;:?*$%&#")
        if core.isalpha() or core and not core.isascii() and core.decode("utf-8", "replace").isalpha():
            got = self._core(core.lower()) + (self._core(run[len(core) :]) if len(core) < len(run) else b"")
        else:
            got = self._core(run)
        self[run] = got
        return got

    def of(self, texts: list[str | None], end: int | None = END_ID) -> list[bytes]:
        """One bytes object for each text (null: as empty), with the end id after it."""
        tail, ids = b"" if end is None else int(end).to_bytes(4, "little"), self.__getitem__
        out = []
        for text in texts:
            if len(self) > self.entries:
                self.clear()
            out.append(b"".join(map(ids, text.encode("utf-8", "surrogatepass").split())) + tail if text else tail)
        return out
