"""What the entry file gives where the optional subpackage can't be imported, and shared folders."""

import json
import os
import subprocess
import sys

import pytest

from tidemark import catalog, runtime

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_core_queries_without_optional_packages():
    code = "import json, sys; sys.modules['tokenizers'] = None; import __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    names, sql = json.loads(done.stdout)
    assert names == sorted(catalog.queries()) == sql
    assert len(names) >= 100


def test_a_cluster_must_name_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Session.conf

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session)


def test_scratch_is_deleted(spark):
    with runtime.scratch(spark):
        frame = runtime.saved(spark.range(10).toDF("x"))
        place = frame.inputFiles()[0].removeprefix("file://")
        assert frame.count() == 10 and os.path.exists(place)
    assert not os.path.exists(os.path.dirname(os.path.dirname(place)))
    assert runtime.saved(spark.range(3).toDF("x")).count() == 3
