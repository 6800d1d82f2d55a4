"""Masks, blocks, comparisons and small sources."""

import json

import numpy as np
import pytest

from spindrift.kernels import regions as R
from spindrift.kernels.volumes import pack, sphere
from spindrift.sources import files


def test_holes_are_filled_slice_by_slice():
    ct = np.full((2, 7, 7), -1000.0)
    ct[:, 1:6, 1:6] = -600
    ct[0, 3, 3] = 50  # a vessel
    ct[1, 3, 3:] = 50  # open to the border
    m = R.lung_mask(ct)
    assert m[0].sum() == 25 and m[1].sum() == 22
    assert R.lung_mask(ct[:0]).shape == (0, 7, 7)
    assert R.filled(np.zeros((3, 3), bool)).sum() == 0 and R.filled(np.ones((3, 3), bool)).all()


def test_growing_stays_in_its_component_and_reach():
    ct = np.full((40, 40, 40), -800.0)
    ct[10:13, 10:13, 10:13] = 0
    ct[20:23, 20:23, 20:23] = 0
    m = R.grow(ct, (11, 11, 11))
    assert m.sum() == 27 and m[11, 11, 11] == 1
    ct[11, 11, :] = 0
    assert R.grow(ct, (11, 11, 11))[11, 11].nonzero()[0].tolist() == list(range(24))
    ball = R.grow(ct, (30, 30, 30))
    grid = np.indices((11, 11, 11)) - 5
    assert ball.sum() == ((grid**2).sum(axis=0) <= 25).sum()
    assert R.grow(ct, (39, 0, 39)).sum() < ball.sum()


def test_blocks_repeat_the_edge():
    v = np.arange(27).reshape(3, 3, 3)
    block, corner = R.block_around(v, (0, 1, 2), 0.5, boundary=1)
    assert block.shape == (5, 5, 5) and corner == (-2, -1, 0) and block.dtype == np.float32
    assert block[0, 0, 0] == v[0, 0, 0] and block[4, 4, 4] == v[2, 2, 2] and block[2, 2, 2] == v[0, 1, 2]


def test_comparison_of_volumes():
    a = sphere(8, 3.0).astype(np.float32)
    b = a.copy()
    b[0, 0, 0] += 0.5
    got = R.compare_volumes(pack(a), pack(b))
    assert got == {"same_geometry": True, "max_diff": 0.5, "mean_diff": 0.5 / 512, "n_over": 1}
    assert R.compare_volumes(pack(a), pack(a, spacing=(2, 1, 1)))["same_geometry"] is False
    assert R.compare_volumes(pack(a), pack(a[:4]))["max_diff"] is None


def test_names_and_pairs(spark, tmp_path):
    (tmp_path / "x.csv").write_text("patient_id,f 1,f2\n1,2,3\n")
    assert files.column_names(spark, str(tmp_path / "x.csv")) == ["patient_id", "f 1", "f2"]
    spark.range(1).write.parquet(str(tmp_path / "y.parquet"))
    assert files.column_names(spark, str(tmp_path / "y.parquet")) == ["id"]
    pairs = [{"name": "d", "minuend": "late", "subtrahend": "early"}]
    (tmp_path / "p.json").write_text(json.dumps(pairs))
    (tmp_path / "p.yaml").write_text("- name: d\n  minuend: late\n  subtrahend: early\n")
    assert files.read_pairs(spark, str(tmp_path / "p.json")) == pairs == files.read_pairs(spark, str(tmp_path / "p.yaml"))
    (tmp_path / "q.json").write_text("{}")
    with pytest.raises(ValueError):
        files.read_pairs(spark, str(tmp_path / "q.json"))
