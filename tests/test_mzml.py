"""Spectra by byte ranges: the index, and that other spectra are neither read nor decoded."""

import base64
import os
import zlib

import numpy as np
import pytest

from massloom.sources import mzml, readers


def spectrum(scan, values, payload=None):
    body = payload or base64.b64encode(zlib.compress(np.asarray(values, "<f8").tobytes())).decode()
    cv = lambda name, value="": f'<cvParam name="{name}" value="{value}"/>'
    array = lambda name: f"<binaryDataArray>{cv('64-bit float')}{cv('zlib compression')}{cv(name)}<binary>{body}</binary></binaryDataArray>"
    return (
        f'<spectrum index="{scan}" id="controllerType=0 scan={scan}" defaultArrayLength="{len(values)}">{cv("ms level", 2 if scan % 4 else 1)}'
        f'<scanList><scan>{cv("scan start time", scan / 10)}</scan></scanList>\n<binaryDataArrayList>{array("m/z array")}{array("intensity array")}</binaryDataArrayList></spectrum>\n'
    )


def document(path, scans, indexed, odd=()):
    """Spectra with ``scan`` values each; those of ``odd`` hold arrays that cannot be decoded."""
    text, places = '<?xml version="1.0" encoding="utf-8"?>\n<indexedmzML><mzML><run><spectrumList count="9">\n', []
    for s in scans:
        places.append(len(text.encode()))
        text += spectrum(s, np.arange(s) + 100.0, "!not base64 at all!" if s in odd else None)
    text += '</spectrumList><chromatogramList><chromatogram id="TIC"><binary>AAAA</binary></chromatogram></chromatogramList></run></mzML>\n'
    if indexed:
        start = len(text.encode())
        text += '<indexList count="2"><index name="spectrum">' + "".join(f'<offset idRef="scan={s}">{p}</offset>' for s, p in zip(scans, places, strict=True))
        text += f'</index><index name="chromatogram"><offset idRef="TIC">{start - 90}</offset></index></indexList><indexListOffset>{start}</indexListOffset></indexedmzML>'
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("mzml")
    document(path / "one.raw.mzML", range(1, 60), True)
    document(path / "two_uncalibrated.mzML", [5, 700, 70_000], False)
    document(path / "three.mzML", [], True)
    (path / "four.mzML").touch()
    return str(path)


def test_index_equals_the_files(spark, folder):
    rows = mzml.spectra_index(spark, folder).collect()
    assert sorted((r["run"], r["scan_num"]) for r in rows) == [*(("one", s) for s in range(1, 60)), ("two", 5), ("two", 700), ("two", 70_000)]
    for r in rows:
        with open(r["file"].removeprefix("file:"), "rb") as f:
            f.seek(r["start"])
            text = f.read(r["stop"] - r["start"])
        assert text.startswith(b"<spectrum ") and f"scan={r['scan_num']}\"".encode() in text[:80] and text.count(mzml.END) == 1


def test_search_finds_tags_across_blocks(monkeypatch, folder):
    whole = {}
    for block in (1 << 20, 7, 64):
        monkeypatch.setattr(mzml, "BLOCK", block)
        for name in sorted(os.listdir(folder))[1:3]:
            path = os.path.join(folder, name)
            if block == 7 and os.path.getsize(path) > 1 << 20:
                continue
            with open(path, "rb") as f:
                found = list(mzml.searched(f, os.path.getsize(path)))
            assert whole.setdefault(name, found) == found and (found or "three" in name)


def test_all_ranges_give_the_spectra_of_a_scan(spark, folder):
    key = lambda r: (r["run"], r["scan_num"])
    want = sorted(readers.spectra_scan(spark, folder + "/*[neo].*mzML").collect(), key=key)
    got = sorted(mzml.spectra_at(mzml.spectra_index(spark, folder + "/*[neo].*mzML")).collect(), key=key)
    assert got == want and len(got) == 45
    long = mzml.spectra_at(mzml.spectra_index(spark, folder).filter("scan_num >= 700")).collect()
    assert [(r["scan_num"], len(r["peaks"])) for r in long if r["scan_num"] % 4] == [] and mzml.spectra_at(mzml.spectra_index(spark, folder).limit(0)).count() == 0


def test_only_wanted_spectra_are_read_and_decoded(spark, tmp_path):
    """All spectra but the wanted ones hold arrays that fail when decoded, and after the index is built their bytes are gone."""
    path = tmp_path / "run.mzML"
    scans = list(range(1, 200))
    wanted = [s for s in scans if s % 50 in (3, 5)]
    document(path, scans, True, odd={s for s in scans if s not in wanted})
    ask = spark.createDataFrame([("run", s) for s in wanted] + [("other", 7), (None, None)], "run string, scan_num long")
    with pytest.raises(Exception, match="base64|binascii|zlib|padding"):
        readers.spectra_scan(spark, str(path)).collect()
    late = readers.spectra_scan(spark, str(path), only=ask)
    assert sorted((r["scan_num"], len(r["peaks"])) for r in late.collect()) == [(s, s) for s in wanted]
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("LeftSemi")

    index = mzml.spectra_index(spark, str(path)).join(ask, ["run", "scan_num"], "left_semi").collect()
    size = os.path.getsize(path)
    raw = path.read_bytes()
    blank = bytearray(b"\xff" * size)
    for r in index:
        blank[r["start"] : r["stop"]] = raw[r["start"] : r["stop"]]
    path.write_bytes(bytes(blank))
    rows = spark.createDataFrame([r.asDict() for r in index], "file string, scan_num long, start long, stop long")
    got = mzml.spectra_at(rows.repartition(3)).collect()
    assert sorted((r["scan_num"], r["peaks"][-1]["mz"]) for r in got) == [(s, 99.0 + s) for s in wanted]
