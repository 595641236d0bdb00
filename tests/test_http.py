import json
import threading
import urllib.error
import urllib.request

import pytest

from quillgate.ask.http import Service, serve
from quillgate.ask.pipeline import Asker, Scripted
from quillgate.demo_catalog import CATALOG as DEMO
from quillgate.domains import load
from quillgate.principals import RateLimit, Registry
from quillgate.session import GovernedSession
from tests.test_guard import _session

REGISTRY = Registry.from_json(json.dumps({"tokens": {"t": "ann", "u": "bob"}, "principals": {"ann": {"allowed_tables": ["sale", "buyer"]}, "bob": {"allowed_tables": ["sale"]}}}))
SCRIPT = {"How many sales?": [{"sql": "select count(*) as n from sale"}], "List the mail": [{"sql": "select mail from buyer"}]}


@pytest.fixture(scope="module")
def address(spark):
    askers = {}

    def asker_for(principal):
        if principal.id not in askers:
            askers[principal.id] = Asker(_session(spark, principal=principal), Scripted(SCRIPT), b"k")
        return askers[principal.id]

    server = serve(Service(REGISTRY, asker_for, RateLimit(burst=20)), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def call(address, path, body=None, token="t"):
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(address + path, data, {"Authorization": f"Bearer {token}"})
    try:
        with urllib.request.urlopen(request, timeout=60) as r:
            text, status = r.read().decode(), r.status
    except urllib.error.HTTPError as e:
        text, status = e.read().decode(), e.code
    return status, json.loads(text) if text.startswith("{") else text


def test_asking_and_confirming(address):
    status, out = call(address, "/ask", {"question": "How many sales?"})
    assert status == 200 and out["status"] == "ok" and out["rows"] == [[60]]
    status, out = call(address, "/ask/confirm", {"question": "How many sales?"})
    assert status == 200 and out["status"] == "confirm"
    assert call(address, "/ask/execute", {"review": out["review"]})[1]["rows"] == [[60]]
    assert call(address, "/ask/execute", {"review": out["review"]}, token="u")[0] == 403
    assert call(address, "/ask/execute", {"review": {**out["review"], "expires": 9e9}})[0] == 403
    status, out = call(address, "/ask", {"question": "List the mail"})
    assert status == 200 and out["code"] in ("restricted_request", "validation_failed")


def test_refusals_and_watching(address):
    assert call(address, "/health") == (200, "ok") and call(address, "/ready")[0] == 200
    assert call(address, "/ask", {"question": "x"}, token="none")[0] == 401
    assert call(address, "/ask", {"question": "x", "more": 1})[0] == 400 and call(address, "/nothing", {"question": "x"})[0] == 404
    call(address, "/ask", {"question": "How many sales?"})
    assert 'asks_total{status="ok"' in call(address, "/metrics")[1]
    assert 429 in [call(address, "/ask", {"question": " "}, token="u")[0] for _ in range(30)]


def test_domains(spark, tmp_path):
    (tmp_path / "world").mkdir()
    spark.createDataFrame([(1, "A")], "r_regionkey int, r_name string").write.parquet(str(tmp_path / "r"))
    (tmp_path / "world" / "catalog.json").write_text(json.dumps(DEMO.slice(["region"]).to_dict()))
    (tmp_path / "world" / "sources.json").write_text(json.dumps({"region": {"format": "parquet", "path": str(tmp_path / "r")}}))
    world = load(tmp_path)["world"]
    assert GovernedSession(spark, world.catalog, world.sources).sql("select r_name from region").first().r_name == "A"
    (tmp_path / "world" / "sources.json").write_text("{}")
    with pytest.raises(ValueError):
        load(tmp_path)
