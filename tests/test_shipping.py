"""Functions sent to executors must not need the package there."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from panelloom.operators import allocation, mixture, sequence


@pytest.mark.parametrize("function", [
    sequence.smooth, sequence.best_path, sequence.blocks, mixture.row_log_density, allocation._divergence,
])
def test_functions_travel_by_value(function, tmp_path):
    packed = tmp_path / "f.pkl"
    packed.write_bytes(cloudpickle.dumps(function))
    code = "import pickle, sys; f = pickle.load(open(sys.argv[1], 'rb')); assert callable(f); assert 'panelloom' not in sys.modules"
    done = subprocess.run([sys.executable, "-I", "-c", code, str(packed)], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
