"""Sums and matches over the theoretical ions of each peptide, where the ions themselves would be too many rows.

Peptides of one length are the columns of a matrix of prefix sums, so an ion kind is a few numpy operations for all of
them; nothing is shuffled and no ion becomes a row. ``residues`` names a column of plain letters or one of arrays of residue
masses with their modifications.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.functions import ions

#: Values of a block of numpy at most (256 KB), and entries of a dictionary that are sent to the tasks at most.
BLOCK, MOST_ENTRIES = 1 << 15, 100_000

_MASS = np.full(256, np.nan)
for _letter, _mass in ions.RESIDUES.items():
    _MASS[ord(_letter)] = _mass


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and lengths of an array of lists or texts (as bytes); a null is empty."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        offsets, values = column.offsets.to_numpy().astype(np.int64), column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    else:
        column = column.cast(pa.large_binary())
        _, at, data = column.buffers()
        offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    size = np.diff(offsets)
    if column.null_count:
        size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, size)
    return values, offsets[:-1], size


def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: some of the rows of that length, and the sums of the first 0, 1, .. residues (a row each) of each of them (a column each)."""
    values, starts, size = _flat(column)
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    for n, alike in zip(lengths.tolist(), np.split(order, first[1:]), strict=True):
        width = max(16, 128 * BLOCK // (n + 1) ** 2)
        for rows in (alike[k : k + width] for k in range(0, len(alike), width)):
            held = values[starts[rows] + np.arange(n)[:, None]]
            upto = np.zeros((n + 1, len(rows)))
            np.cumsum(_MASS[held] if held.dtype == np.uint8 else held, axis=0, out=upto[1:])
            yield rows, upto


def _whole(values: np.ndarray) -> pa.Array:
    """Whole numbers; what is no number is null."""
    lost = np.isnan(values)
    return pa.array(np.where(lost, 0, values).astype(np.int64), mask=lost)


def _mapped(rows: DataFrame, key: str, fields: list[T.StructField], one) -> DataFrame:
    """key and ``fields`` of each row; ``one`` makes their arrays of the columns after the key, which is the first."""
    schema = T.StructType([rows.schema[key], *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *one(*batch.columns[1:])], names=names)

    return rows.mapInArrow(run, schema)


def internal_sums(peptides: DataFrame, losses: tuple[str, ...] = ("H2O", "NH3"), *, key: str = "peptide", residues: str = "peptide", first: int = 2, digits: int = 4) -> DataFrame:
    """(key, ion, loss, n, total): the number of the ions of ``ions.internal`` of each type and loss and the sum of their m/z, each rounded to ``digits`` and counted in units of the last."""
    scale = 10.0**digits
    kinds = [(ion, loss, (offset - ions.LOSSES.get(loss, 0.0) + ions.PROTON) * scale + 0.5) for ion, offset in (("b", 0.0), ("a", -ions.CARBONYL)) for loss in ("", *losses)]

    def sums(column: pa.Array) -> list[pa.Array]:
        count, totals = np.zeros(len(column), np.int64), np.zeros((len(kinds), len(column)))
        for rows, upto in blocks(column):
            n = len(upto) - 1
            pairs = (n - first - 1) * (n - first) // 2
            if n < first + 2:
                continue
            count[rows] = pairs
            width = max(16, BLOCK // pairs)
            for low in range(0, len(rows), width):
                to, at, start = rows[low : low + width], upto[:, low : low + width] * scale, first
                while start < n - 1:  # so many starts at a time that their parts fill a block; a part ends after its start and before the last residue
                    parts = [at[start + 1 : n] - at[start - 1]]
                    room, start = BLOCK // len(to) - len(parts[0]), start + 1
                    while start < n - 1 and room >= n - 1 - start:
                        parts.append(at[start + 1 : n] - at[start - 1])
                        room, start = room - (n - 1 - start), start + 1
                    part = np.concatenate(parts)
                    spare = np.empty_like(part)
                    for j, (_, _, constant) in enumerate(kinds):
                        np.floor(np.add(part, constant, out=spare), out=spare)
                        totals[j, to] += spare.sum(axis=0)
        return [pa.array(count), *map(_whole, totals)]

    found = _mapped(peptides.select(key, F.col(residues).alias("__residues")), key, [T.StructField("n", T.LongType()), *(T.StructField(f"t{j}", T.LongType()) for j in range(len(kinds)))], sums)
    one = lambda j, ion, loss: F.struct(F.lit(ion).alias("ion"), F.lit(loss).alias("loss"), F.col("n"), F.col(f"t{j}").alias("total"))
    return found.filter("n > 0").select(key, F.explode(F.array(*(one(j, ion, loss) for j, (ion, loss, _) in enumerate(kinds)))).alias("x")).select(key, "x.*")


def possible_ion_sums(peptides: DataFrame, dictionary: DataFrame, *, activation: str = "HCD", key: str = "peptide", letters: str = "peptide", residues: str = "peptide", charge: str = "charge", digits: int = 4) -> DataFrame:
    """(key, ion, n, total): the number of the ions of ``ions.possible_ions`` of each type and the sum of their m/z, each rounded to ``digits`` and counted in units of the last.

    The dictionary is a parameter, sent to the tasks; one of over MOST_ENTRIES ions is joined instead.
    """
    entries = dictionary.select("ion", "number", F.col("charge").cast("double").alias("charge"), "start", "extent", "residue", "lost", "needs", "mass").limit(MOST_ENTRIES + 1).collect()
    unit = 10.0**digits
    if len(entries) > MOST_ENTRIES:
        rows = peptides if residues != letters else peptides.withColumn("__residues", ions.masses(F.col(letters)))
        found = ions.possible_ions(rows, dictionary, activation=activation, key=key, letters=letters, residues=residues if residues != letters else "__residues", charge=charge)
        return found.groupBy(key, "ion").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("mz") * unit + 0.5)).alias("total"))

    electron = activation not in ("HCD", "CID")
    kinds = list(dict.fromkeys(e["ion"] for e in entries))
    needs = list(dict.fromkeys(e["needs"] for e in entries))
    ladder: dict[tuple, list[int]] = {}
    inner: dict[tuple, list[tuple[int, int]]] = {}
    single: list[tuple] = []
    for e in entries:
        about = (e["ion"], np.nan if e["charge"] is None else e["charge"], e["lost"], e["needs"])
        if e["ion"] == "imm":
            single.append((*about, e["residue"], e["mass"]))
        elif e["ion"] == "p":
            if e["charge"] == 0 or electron:
                single.append((*about, None, None))
        elif e["ion"] == "int":
            if e["start"] is not None and e["start"] >= 2 and e["extent"] is not None:
                inner.setdefault(about, []).append((e["start"], e["start"] + e["extent"] - 1))
        elif e["number"] is not None:
            ladder.setdefault(about, []).append(e["number"])
    ladders = [(*about, np.sort(numbers)) for about, numbers in ladder.items()]
    inners = [(*about, np.array(ends)) for about, ends in inner.items()]

    def sums(column: pa.Array, text: pa.Array, deltas: pa.Array, charges: pa.Array) -> list[pa.Array]:
        count, totals = np.zeros((len(kinds), len(column)), np.int64), np.zeros((len(kinds), len(column)))
        moved, begun, many = _flat(deltas)
        moved = moved[begun[0] : begun[-1] + many[-1]] if len(many) else moved
        owner, has = np.repeat(np.arange(len(many)), many), {None: np.ones(len(column), bool)}
        for need in needs:
            if need is not None:
                has[need] = np.zeros(len(column), bool)
                has[need][owner[np.abs(moved - need) <= 0.0002]] = True
        own = charges.cast(pa.float64()).to_numpy(zero_copy_only=False)
        bytes_, starts, size = _flat(text)

        def add(ion: str, rows: np.ndarray, n, masses: np.ndarray, z, lost: float) -> None:
            k = kinds.index(ion)
            count[k, rows] += n
            totals[k, rows] += np.floor((masses - lost + z * ions.PROTON) / z * unit + 0.5).sum(axis=0)

        for rows, upto in blocks(column):
            n = int(size[rows[0]])
            held = bytes_[starts[rows] + np.arange(n)[:, None]]
            masks = {need: has[need][rows] for need in needs}
            some = {need: (rows, upto) if mask.all() else (rows[mask], upto[:, mask]) for need, mask in masks.items()}
            for ion, z, lost, need, numbers in ladders:
                at, (to, sums_) = numbers[(numbers >= 1) & (numbers < n)], some[need]
                if len(at) and len(to):
                    masses = sums_[-1] - sums_[n - at] + ions.WATER if ion == "y" else sums_[at] + (-ions.CARBONYL if ion == "a" else 0.0)
                    add(ion, to, len(at), masses, z, lost)
            for ion, z, lost, need, ends in inners:
                at, (to, sums_) = ends[(ends[:, 1] >= 1) & (ends[:, 1] < n) & (ends[:, 0] <= n)], some[need]
                if len(at) and len(to):
                    add(ion, to, len(at), sums_[at[:, 1]] - sums_[at[:, 0] - 1], z, lost)
            present: dict[str, np.ndarray] = {}
            for ion, z, lost, need, residue, mass in single:
                to, sums_ = some[need]
                if ion == "p":
                    add(ion, to, 1, sums_[-1:] + ions.WATER, own[to] if z == 0 else z, lost)
                elif residue is not None and len(residue) == 1:
                    if residue not in present:
                        present[residue] = (held == ord(residue)).any(axis=0)
                    hit, k = rows[present[residue] & masks[need]], kinds.index(ion)
                    count[k, hit] += 1
                    totals[k, hit] += np.nan if mass is None else np.floor(mass * unit + 0.5)
        return [*map(pa.array, count), *map(_whole, totals)]

    columns = [F.col(residues).alias("__residues"), F.col(letters).alias("__letters"), F.coalesce("deltas", F.array().cast("array<double>")).alias("__deltas"), F.col(charge).alias("__charge")]
    fields = [T.StructField(f"{c}{k}", T.LongType()) for c in "nt" for k in range(len(kinds))]
    if not kinds:
        return peptides.select(key, F.lit("").alias("ion"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total")).limit(0)
    found = _mapped(peptides.select(key, *columns), key, fields, sums)
    one = lambda k, ion: F.struct(F.lit(ion).alias("ion"), F.col(f"n{k}").alias("n"), F.col(f"t{k}").alias("total"))
    return found.select(key, F.explode(F.array(*(one(k, ion) for k, ion in enumerate(kinds)))).alias("x")).select(key, "x.*").filter("n > 0")


def ladder_names(peptides: DataFrame, asked: Column, priority: list[str], *, tolerance: float, unit: str = "da", key: str = "peptide", residues: str = "peptide") -> DataFrame:
    """(key, names): for each m/z of ``asked`` (an array) the annotation that ``annotate`` gives by the peptide's own ladder.

    The ladder has the ion types of ``priority`` at charge 1, named by type and number. Names of the first type with a hit in
    the window are joined by ``;`` in the order of texts, ``unknown`` without a hit or m/z.
    """

    def annotated(column: pa.Array, wanted: pa.Array) -> list[pa.Array]:
        values, begun, many = _flat(wanted)
        first = np.concatenate(([0], np.cumsum(many)))
        names, known = ["unknown"], {"unknown": 0}
        codes = np.zeros(first[-1], np.int32)

        def code(name: str) -> int:
            if name not in known:
                known[name] = len(names)
                names.append(name)
            return known[name]

        for rows, upto in blocks(column):
            n = len(upto) - 1
            if n < 2:
                continue
            theory = {ion: (upto[1:-1] + ions.PREFIX[ion] if ion in ions.PREFIX else upto[-1] - upto[-2:0:-1] + ions.SUFFIX[ion]) + ions.PROTON for ion in priority}
            own = {ion: np.array([code(f"{ion}{k}") for k in range(1, n)], np.int32) for ion in priority}
            for q in range(int(many[rows].max())):
                here = np.flatnonzero(many[rows] > q)
                at = values[begun[rows[here]] + q]
                low, high = (at * (1 - tolerance * 1e-6), at * (1 + tolerance * 1e-6)) if unit == "ppm" else (at - tolerance, at + tolerance)
                open_ = np.ones(len(here), bool)
                for ion in priority:
                    number, who = np.nonzero((theory[ion][:, here] >= low) & (theory[ion][:, here] <= high) & open_)
                    hits = np.bincount(who, minlength=len(here))
                    alone = hits[who] == 1
                    codes[first[rows[here[who[alone]]]] + q] = own[ion][number[alone]]
                    several: dict[int, list[str]] = {}
                    for k, w in zip(number[~alone].tolist(), who[~alone].tolist(), strict=True):
                        several.setdefault(w, []).append(f"{ion}{k + 1}")
                    for w, found in several.items():
                        codes[first[rows[here[w]]] + q] = code(";".join(sorted(found)))
                    open_ &= hits == 0
        texts = pa.DictionaryArray.from_arrays(pa.array(codes), pa.array(names, pa.string())).cast(pa.string())
        return [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), texts)]

    rows = peptides.select(key, F.col(residues).alias("__residues"), asked.cast("array<double>").alias("__asked"))
    return _mapped(rows, key, [T.StructField("names", T.ArrayType(T.StringType()))], annotated)
