"""What the plans of the core read, and where they may write."""

import os

import pytest

from folioscope.operators import jsontools
from folioscope.plans import materialize
from folioscope.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
COUNTS = ["a1_table_counts", "a2_total_tokens", "a9_optional_fields", "j1_neighbour_chunks", "j2_first_chunks", "j3_section_chunks", "j6_chunks_with_documents", "j13_document_sizes", "w2_chunk_orders", "w4_context_frames", "l3_sections_in_order", "a13_outcomes"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", COUNTS)
def test_counts_read_no_texts(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = [x for x in plan.split("ReadSchema: ")[1:]]
    assert read and not any(c in x.split(">")[0] for x in read for c in ("chunk_text", "text:", "details"))


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    class Session:
        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError, match="checkpoint"):
        materialize.shared_dir(Session)
    monkeypatch.setattr(Session.conf, "get", staticmethod(lambda name, default: "hdfs:///shared/"))
    assert materialize.shared_dir(Session) == "hdfs:///shared"


def test_json_is_found_however_it_is_wrapped(spark):
    texts = ['{"b": 1, "a": [1, "x"]}', ' {"a": null}', 'said: {"a": 2} ok', '```json\n{"a": 3}\n```', '{"a": 4, "b": "cut o', "{broken", "no object", "[1, 2]", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.json, r.broken) for r in jsontools.extracted(df, "id", "text").collect()}
    assert got == {
        0: ('{"a":[1,"x"],"b":1}', False), 1: ('{"a":null}', False), 2: ('{"a":2}', False), 3: ('{"a":3}', False), 4: ('{"a":4,"b":"cut o"}', False),
        5: (None, True), 6: (None, False), 7: (None, False), 8: (None, False),
    }
    assert jsontools.extracted(df.limit(0), "id", "text").count() == 0
