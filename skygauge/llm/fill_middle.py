"""Fill-in-middle texts by a piece table: descriptors over immutable text and sentinel buffers."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skygauge.llm.common import per_row, slices, text_of

SEED, FIM_PERCENT, SPM_PERCENT = 1, 90, 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: For each form: the sentinels in the order they stand, and which part of the text (0 prefix, 1 middle,
#: 2 suffix) follows each.
FORMS = {"psm": ((PREFIX, SUFFIX, MIDDLE), (0, 2, 1)), "spm": ((SUFFIX, PREFIX, MIDDLE), (2, 0, 1))}

_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
_GOES_ON = np.zeros(256, bool)
_GOES_ON[0x80:0xC0] = True


class PieceTable:
    """A text as descriptors (buffer, start, stop) over buffers that never change."""

    def __init__(self, pieces: list[tuple[bytes, int, int]]):
        self.pieces = pieces

    @classmethod
    def of(cls, text: bytes) -> "PieceTable":
        return cls([(text, 0, len(text))])

    def cut(self, places: list[int]) -> "PieceTable":
        """One more descriptor for each of the ascending places, in bytes of the whole; none is dropped."""
        made, at, left = [], 0, list(places)
        for buffer, start, stop in self.pieces:
            while left and left[0] <= at + stop - start:
                middle = start + left.pop(0) - at
                made.append((buffer, start, middle))
                at, start = at + middle - start, middle
            made.append((buffer, start, stop))
            at += stop - start
        return PieceTable(made)

    def arrange(self, order) -> "PieceTable":
        return PieceTable([self.pieces[i] for i in order])

    def led_by(self, sentinels) -> "PieceTable":
        """A sentinel before each descriptor."""
        return PieceTable([p for s, own in zip(sentinels, self.pieces) for p in ((s, 0, len(s)), own)])

    def sha256(self) -> str:
        """Streams the descriptors through the hash; the whole is not put together."""
        held = hashlib.sha256()
        for buffer, start, stop in self.pieces:
            held.update(memoryview(buffer)[start:stop])
        return held.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(memoryview(b)[start:stop] for b, start, stop in self.pieces)


def unit_starts(text: bytes) -> np.ndarray:
    """Where units start: a run of A-Z and a-z is one, any other code point is one."""
    codes = np.frombuffer(text, np.uint8)
    letter = _LETTER[codes]
    inside = _GOES_ON[codes]
    inside[1:] |= letter[1:] & letter[:-1]
    return np.flatnonzero(~inside)


def code_points(text: bytes, start: int, stop: int) -> int:
    return int(np.count_nonzero(~_GOES_ON[np.frombuffer(text, np.uint8, stop - start, start)])) if stop > start else 0


def transform(text: bytes, draw: str, fim_percent: int, spm_percent: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, piece table) of one text; ``draw`` is 32 hex digits or more."""
    h = [int(draw[i:i + 8], 16) for i in (0, 8, 16, 24)]
    starts = unit_starts(text)
    n = len(starts)
    whole = PieceTable.of(text)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, whole
    ends = [int(starts[k]) if k < n else len(text) for k in sorted((h[0] % (n + 1), h[1] % (n + 1)))]
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    sentinels, order = FORMS[form]
    made = whole.cut(ends).arrange(order).led_by(sentinels)
    return n, form, code_points(text, 0, ends[0]), code_points(text, *ends), made


def restore(output: bytes, form: str) -> PieceTable:
    """The text's descriptors over an output and its form: cut at the sentinels, which no part of the
    text holds, drop them, and apply the inverse permutation."""
    whole = PieceTable.of(output)
    if form not in FORMS:
        return whole
    sentinels, order = FORMS[form]
    places, at = [], 0
    for s in sentinels:
        at = output.index(s, at)
        places += [at, at + len(s)]
        at += len(s)
    parts = whole.cut(places).arrange((2, 4, 6))
    inverse = sorted(range(len(order)), key=order.__getitem__)
    return parts.arrange(inverse)


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
    fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, outputs: bool = True,
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256[, output]), one row per row.

    A text of n units (runs of A-Z and a-z, single other code points) is cut after two counts of units
    drawn from sha256("seed:id"); its parts stand as prefix, suffix, middle (psm) or suffix, prefix,
    middle (spm), each behind its sentinel. Empty and null texts, texts that hold a sentinel and
    those that the draw leaves out stay as they are (plain; lengths null). ``restored_sha256`` is of the
    text rebuilt from output and form alone. ``outputs=False`` returns digests without the texts.

    Whole texts are cut, however long: a task holds one slice of texts and, per text, its
    output. Rows with one id are cut at the same draws; a null id draws as an empty one. Repeated rows give
    repeated rows, an empty table none; other columns are not read. No shuffle.
    """
    schema = ("n long, form string, prefix_chars long, middle_chars long, "
              "output_sha256 string, restored_sha256 string" + ", output string" * outputs)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    picked = df.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"), draw.alias("draw"))
    made = StructType([picked.schema[0], *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4 << 20):
                rows = []
                for text, drawn in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    *told, table = transform(text, drawn, fim_percent, spm_percent)
                    output = table.bytes()
                    rows.append((*told, table.sha256(), restore(output, told[1]).sha256(), *[output] * outputs))
                columns = [pa.array(c, pa.binary() if f.name == "output" else f.type) for c, f in zip(zip(*rows), list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), *(c.cast(f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)

    return picked.mapInArrow(run, made)


def restore_texts(df: DataFrame, id_col: str = "id", output_col: str = "output", form_col: str = "form") -> DataFrame:
    """(id, text): the texts that ``fill_in_middle`` was given (empty for null), from output and form.

    A null output gives an empty text; a null or unknown form counts as plain.
    """
    def open_task():
        def run(marked):
            return ([restore(m[6:].encode(), m[1:4]).bytes().decode() for m in marked],)
        return run

    form = F.when(F.col(form_col).isin(*FORMS), F.col(form_col)).otherwise("all")
    marked = F.concat(F.lit("["), form, F.lit("] "), text_of(output_col))
    return per_row(df, {"id": F.col(id_col), "marked": marked}, "text string", open_task)
