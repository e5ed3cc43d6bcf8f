"""bench.py prints one JSON line with the fields the driver reads."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test data missing")
def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF, BENCH_CPUS="2", BENCH_REPEAT="1")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "category_breakdown",
                          "optimal_portfolio"], env=env, capture_output=True, text=True,
                         timeout=600, check=True)
    last = out.stdout.strip().splitlines()[-1]
    d = json.loads(last)
    assert d["unit"] == "sec" and d["sf"] == 0.001 and d["cpus"] == 2
    assert set(d["queries"]) == {"category_breakdown", "optimal_portfolio"}
    assert d["value"] == pytest.approx(sum(d["queries"].values()), abs=0.01)
