"""Sentence segmentation by sentence-break classes, the primary splitter of the semantic chunker.

A sentence ends after a paragraph break, after a mark that always ends one
(``! ?`` and their like), or after a full stop, with closing marks and spaces
that follow.  A full stop ends none before a digit, between a letter and a
capital, or where the next letter, over digits, spaces and signs, is a small one;
no mark ends one before a comma, colon or another such mark.  Combining and
invisible characters belong to what they follow.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Combining and invisible characters after any other.
_X = r"[\p{SB=Extend}\p{SB=Format}]*+"
_PARAGRAPH = r"(?:\r\n|[\r\n\p{SB=Sep}])"
_CLOSE_SPACE = rf"(?:\p{{SB=Close}}{_X})*+(?:\p{{SB=Sp}}{_X})*+"
_LETTER = r"[\p{SB=Upper}\p{SB=Lower}]"
#: What may stand between a full stop and a small letter that goes on with the sentence.
_BETWEEN = r"[^\p{SB=OLetter}\p{SB=Upper}\p{SB=Lower}\p{SB=Sep}\r\n\p{SB=ATerm}\p{SB=STerm}]*+"
_GOES_ON = r"[\p{SB=SContinue}\p{SB=ATerm}\p{SB=STerm}]"
END = regex.compile(
    rf"""{_PARAGRAPH}
    | \p{{SB=STerm}}{_X}{_CLOSE_SPACE}(?:{_PARAGRAPH}|(?!{_GOES_ON}))
    | \p{{SB=ATerm}}{_X}(?!\p{{SB=Numeric}})(?<!{_LETTER}[\p{{SB=Extend}}\p{{SB=Format}}]*\p{{SB=ATerm}}[\p{{SB=Extend}}\p{{SB=Format}}]*(?=\p{{SB=Upper}}))
      {_CLOSE_SPACE}(?:{_PARAGRAPH}|(?!{_GOES_ON})(?!{_BETWEEN}\p{{SB=Lower}}))
    """,
    regex.VERBOSE,
)
#: Fixed value: white space that trimming removes besides what Python's does.
TRIMMED = "﻿"


def boundaries(text: str) -> list[int]:
    """Where sentences end; the text's end is the last."""
    found = [m.end() for m in END.finditer(text)]
    return found if found and found[-1] == len(text) else [*found, len(text)]


def sentences(text: str) -> list[str]:
    """Trimmed sentences, empty ones left out."""
    out, start = [], 0
    for end in boundaries(text):
        if part := _trim(text[start:end]):
            out.append(part)
        start = end
    return out


def _trim(part: str) -> str:
    while True:
        cut = part.strip().strip(TRIMMED)
        if cut == part:
            return cut
        part = cut


def with_sentences(df: DataFrame, text_col: str, out_col: str = "sentences") -> DataFrame:
    """Adds the sentences of each text; null for a null text."""
    at = df.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out_col}` array<string>"

    def run(stream):
        for batch in stream:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [None if t is None else sentences(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.string()))], names=[*part.schema.names, out_col])

    return df.mapInArrow(run, schema)
