import io
import urllib.error

import pytest

from tessera.operators import reports
from tessera.settings import load_env, resolve_key
from tessera.sources.http import getter


def test_keys(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text("# note\nKEY='filed'\nbroken\nOTHER=changeme\n")
    monkeypatch.delenv("KEY", raising=False)
    assert load_env(env) == {"KEY": "filed", "OTHER": "changeme"} and load_env(tmp_path / "none") == {}
    assert resolve_key("KEY", None, env) == "filed" and resolve_key("KEY", "own", env) == "own"
    with pytest.raises(KeyError):
        resolve_key("OTHER", None, env)


def test_getter_tries_again():
    calls, slept = [], []

    def opener(status):
        def open_(request, timeout):
            calls.append(request.full_url)
            if len(calls) < 3:
                raise urllib.error.HTTPError(request.full_url, status, "", {}, io.BytesIO())
            return io.BytesIO("é".encode())

        return open_

    assert getter(opener=opener(503), sleep=slept.append)("http://x/") == "é" and slept == [1, 2]
    calls.clear()
    with pytest.raises(RuntimeError, match="HTTP 404"):
        getter(opener=opener(404), sleep=slept.append)("http://x/")
    assert len(calls) == 1


def test_low_confidence(spark):
    rows = [("f", p, str(p), "low" if p % 2 else "high", "t" * 200, "posts") for p in range(10)]
    df = spark.createDataFrame(rows, "source_file string, page int, id string, confidence string, text string, wp_type string")
    got = reports.low_confidence(df).collect()
    assert [r["page"] for r in got] == [1, 3, 5] and len(got[0]["text"]) == 100
    assert reports.kind_report(df).first()["items"] == 10
