"""Columns of many small records as byte strings: one shuffled row carries a sorted run of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def runs_by(group: np.ndarray, columns: dict[str, np.ndarray]):
    """(group, columns) for each distinct group; the order within a group is kept."""
    if not len(group):
        return
    order = np.argsort(group, kind="stable")
    group = group[order]
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    stop = np.concatenate([edge[1:], [len(group)]])
    sorted_ = {k: v[order] for k, v in columns.items()}
    for a, b in zip(edge, stop):
        yield int(group[a]), {k: v[a:b] for k, v in sorted_.items()}


def put_ids(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Distinct ids and places among them, two bytes a place where that is enough."""
    distinct, place = np.unique(ids, return_inverse=True)
    return distinct.astype(np.int64).tobytes(), place.astype(np.uint16 if len(distinct) < 1 << 16 else np.uint32).tobytes()


def get_ids(distinct: bytes, place: bytes) -> np.ndarray:
    ids = np.frombuffer(distinct, np.int64)
    return ids[np.frombuffer(place, np.uint16 if len(ids) < 1 << 16 else np.uint32)] if len(ids) else np.zeros(0, np.int64)


def distinct_rows(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct pair of id and row hash first stands, place of each pair among them). A hash alone names no row."""
    order = np.lexsort((ids, rows))
    if not len(order):
        return order, order
    start = np.ones(len(order), bool)
    start[1:] = (rows[order][1:] != rows[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(start) - 1
    return order[start], place


def put_rows(ids: np.ndarray, rows: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """As `put_ids` for documents named by id and row hash together, so that rows sharing an id stay apart."""
    first, place = distinct_rows(ids, rows)
    return (ids[first].astype(np.int64).tobytes(), rows[first].astype(np.int64).tobytes(),
            place.astype(np.uint16 if len(first) < 1 << 16 else np.uint32).tobytes())


def get_rows(ids: bytes, rows: bytes, place: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
    at = np.frombuffer(place, np.uint16 if len(ids) < 1 << 16 else np.uint32)
    return (ids[at], rows[at]) if len(ids) else (ids, rows)


def put_planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, all first bytes, then all second ones: sorted values compress well so."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width:].T).tobytes()


def get_planes(value: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(value, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, 8 - width:] = raw.T
    return out.view(">u8").ravel().astype(np.uint64)


def get(value: bytes, kind) -> np.ndarray:
    return np.frombuffer(value, kind)


def batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: pa.array([r[f.name] for r in rows], f.type) for f in schema}, schema=schema)


def list_column(values: np.ndarray, counts: np.ndarray, kind=pa.int64()) -> pa.Array:
    """One list per count, cut from the values in order."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))
