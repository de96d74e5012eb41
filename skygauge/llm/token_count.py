"""Token counts with a public tokenizer, returning lengths only."""

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import per_row, text_of
from skygauge.llm.pieces import SAFE

LIMIT = 512
CALL_BYTES = 1 << 20
KEEP = 1 << 18


class Counter:
    """Counts tokens of texts by encoding their segments in batches of bounded size.

    Byte-level tokenizers (.json) are fed segments cut at safe boundaries, each distinct one
    of a slice once; lengths of frequent segments are kept in a table of at most KEEP entries.
    Strings of special tokens are segments of their own. Piece models (.model) look at whole
    texts, so those are encoded uncut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.cut = path.endswith(".json")
        if self.cut:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            kind = type(self.model.pre_tokenizer).__name__
            if kind != "ByteLevel" or self.model.normalizer is not None:
                raise ValueError(f"safe boundaries are known for plain byte-level tokenizers, not {kind}")
            special = [t.content for t in self.model.get_added_tokens_decoder().values()]
            self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
            self.first = tuple(special)
        else:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, int] = {}

    def _lengths(self, texts: list[str]) -> list[int]:
        """Encode in calls of about CALL_BYTES characters and keep the lengths only."""
        lengths, start, held = [], 0, 0
        for at, text in enumerate(texts):
            held += len(text)
            if held >= CALL_BYTES or at == len(texts) - 1:
                call = texts[start:at + 1]
                if self.cut:
                    lengths += [len(e) for e in self.model.encode_batch_fast(call, add_special_tokens=False)]
                else:
                    lengths += [len(e) for e in self.model.encode(call, num_threads=1)]
                start, held = at + 1, 0
        return lengths

    def _segments(self, text: str) -> list[str]:
        if self.special and any(s in text for s in self.first):
            return [s for i, part in enumerate(self.special.split(text))
                    for s in ([part] if i % 2 else SAFE.findall(part))]
        return SAFE.findall(text)

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.cut:
            return self._lengths(texts)
        cut = [self._segments(t) for t in texts]
        new = list({s for segments in cut for s in segments}.difference(self.known))
        if len(self.known) + len(new) > KEEP:
            self.known = {}
            new = list({s for segments in cut for s in segments})
        self.known.update(zip(new, self._lengths(new)))
        get = self.known.__getitem__
        return [sum(map(get, segments)) for segments in cut]


def count_tokens(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per row, without special tokens added.

    ``tokenizer`` is the path of a byte-level tokenizer file (.json) or a piece model (.model)
    that every executor has. Whole texts count, however long; a null text is empty and has 0
    tokens; repeated rows give repeated rows; an empty table gives none. Other columns are not
    read. There is no shuffle: tasks read equal bytes and encode in slices of equal bytes.
    """
    def open_task():
        count = Counter(tokenizer)

        def run(texts):
            tokens = count(texts)
            return [len(t.encode()) for t in texts], tokens, [n > limit for n in tokens]
        return run

    return per_row(
        df, {"id": F.col(id_col), "text": text_of(text_col)},
        "n_bytes long, n_tokens long, over_limit boolean", open_task,
    )
