"""The caller's models as stages: transcription, assessment, music detection, separation, encoding, or any other.

A model is what ``load()`` gives in each worker, once: a function from a list of rows (dicts of the input columns) to a list of results (dicts). Rows
go to it in batches of bounded bytes. What a model can't do becomes a row with an error, and doesn't stop its neighbours. Results carry
the keys by which a later run may take them over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Model = Callable[[list[dict]], list[dict]]

#: What each kind of model is asked and gives.
HOOKS = {
    "transcribe": (("audio_path",), "transcript string, uncertain_spans array<string>"),
    "assess": (("audio_path", "transcript"), "assessment map<string,boolean>"),
    "detect_music": (("audio_path",), "probability double"),
    "separate": (("audio_path",), "audio_path_separated string, audio_sha256_separated string"),
    "encode": (("audio_path",), "tokens array<array<int>>, frames int"),
}

_loaded: dict[str, Model] = {}


def _bytes(value: Any) -> int:
    if isinstance(value, str | bytes):
        return len(value)
    if isinstance(value, dict):
        return sum(map(_bytes, value.values()))
    return 8 + sum(map(_bytes, value)) if isinstance(value, list) else 8


def with_model(df: DataFrame, load: Callable[[], Model], inputs: tuple[str, ...], outputs: str, name: str, batch_bytes: int = 4_000_000, batch_rows: int = 256, keys: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the columns ``outputs`` of the model's results, ``status`` (ok or error) and ``error``; and ``keys``, constants such as the model's and the prompt's ids.

    A batch that raises is tried again row by row, and only rows that raise alone, or whose result isn't a dict of the right kinds, are errors; their outputs are null.
    ``name`` tells models of one worker apart. Names of new columns that ``df`` has already are replaced. Put ``df.repartition`` before it where rows are few and slow.
    """
    fields = StructType.fromDDL(outputs)
    mine = [*fields.names, "status", "error"]
    rest = df.drop(*(c for c in mine if c not in inputs), *(keys or {}))
    clash = [c for c in mine if c in rest.columns]
    if clash:
        raise ValueError(f"outputs have the names of inputs: {clash}")
    schema = StructType([*rest.schema.fields, *fields.fields]).add("status", "string").add("error", "string")

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded[name] = load()
        model = _loaded[name]

        def sound(result: Any) -> dict:
            if not isinstance(result, dict):
                raise TypeError("a result must be an object")
            given = {f: list(v.items()) if isinstance(v := result.get(f), dict) and pa.types.is_map(kinds.field(f).type) else v for f in fields.names}
            for f, v in given.items():
                pa.array([v], kinds.field(f).type)  # raises on another kind
            return given | {"status": "ok", "error": None}

        def alone(row: dict) -> dict:
            try:
                [result] = model([row])
                return sound(result)
            except Exception as e:  # whatever a caller's model raises is that row's error
                return dict.fromkeys(fields.names) | {"status": "error", "error": f"{type(e).__name__}: {e}"[:500]}

        def several(rows: list[dict]) -> list[dict]:
            try:
                results = model(rows)
                if len(results) != len(rows):
                    raise ValueError("a model must give a result for each row")
                return [sound(r) for r in results]
            except Exception:
                return [alone(r) for r in rows]

        for batch in batches:
            rows = batch.select(list(inputs)).to_pylist() if inputs else [{} for _ in range(batch.num_rows)]
            done, held, size = [], [], 0
            for row in rows:
                n = _bytes(row)
                if held and (size + n > batch_bytes or len(held) == batch_rows):
                    done += several(held)
                    held, size = [], 0
                held.append(row)
                size += n
            if held:
                done += several(held)
            more = [pa.array([d[c] for d in done], kinds.field(c).type) for c in mine]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=kinds.names)

    out = rest.mapInArrow(run, schema)
    return out.withColumns({k: F.lit(v) for k, v in keys.items()}) if keys else out


def hook(df: DataFrame, kind: str, load: Callable[[], Model], model_id: str, **options: Any) -> DataFrame:
    """``with_model`` for one of ``HOOKS``, with ``model_id`` as its key."""
    inputs, outputs = HOOKS[kind]
    return with_model(df, load, inputs, outputs, f"{kind}:{model_id}", keys={"model_id": model_id} | options.pop("keys", {}), **options)
