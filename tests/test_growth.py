"""What one task reads by shuffle, where thousands of entities share an alias: it doesn't follow mentions times entities."""

import pytest
from pyspark.sql import functions as F

from marlstone import catalogue

#: Suppliers, of which each twentieth has one alias; documents before and after.
SUPPLIERS, DOCUMENTS = 60_000, (600, 2400)
BROADCASTS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def corpora(spark, tmp_path_factory):
    s, n = F.col("id") + 1, F.col("id")
    supplier = spark.range(SUPPLIERS).select(s.alias("s_suppkey"), F.concat(F.lit("Supplier#"), F.lpad(s.cast("string"), 9, "0")).alias("s_name"))
    region = spark.range(5).select(n.alias("r_regionkey"), F.concat(F.lit("REGION "), n).alias("r_name"))
    out = []
    for k in DOCUMENTS:
        text = F.concat(F.lit("text "), n)
        documents = spark.range(k).select(n.alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), n % 3).alias("source"), F.char_length(text).cast("long").alias("n_chars"))
        out.append(str(tmp_path_factory.mktemp(f"documents-{k}")))
        for name, table in (("supplier", supplier), ("region", region), ("documents", documents)):
            table.write.parquet(f"{out[-1]}/{name}.parquet")
    return out


@pytest.fixture
def joined_by_shuffle(spark):
    """Tables as large as they are meant here can't be sent to all tasks."""
    for key in BROADCASTS:
        spark.conf.set(key, "-1")
    yield
    for key in BROADCASTS:
        spark.conf.unset(key)


def _stages(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(60_000)
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    found = context.statusStore().stageList(None, False, False, none, None)
    return {found.apply(k).stageId(): found.apply(k) for k in range(found.size())}


def most_read(spark, run) -> int:
    """Bytes that one task of run read by shuffle, at most."""
    before = _stages(spark)
    run()
    store, most = spark.sparkContext._jsc.sc().statusStore(), 0
    for k, stage in _stages(spark).items():
        if k not in before and stage.shuffleReadBytes():
            tasks = store.taskList(k, stage.attemptId(), 10_000)
            for metrics in (tasks.apply(i).taskMetrics() for i in range(tasks.size())):
                if metrics.isDefined():
                    read = metrics.get().shuffleReadMetrics()
                    most = max(most, read.remoteBytesRead() + read.localBytesRead())
    return most


@pytest.mark.parametrize(
    "name",
    [
        "w7_queue_once",
        "j23_pending_examples",
        "k15_audit",
        "a26_identity",
        "e3_name_and_code",
        "a12_counters",
        "g2_typed_edges",
        "a13_mention_audit",
        "a6_document_counts",
        "e6_context",
        "e6_exact",
        "e6_partial",
        "g11_page_graph_index",
        "g12_page_neighbourhood",
    ],
)
def test_no_list_of_entities_goes_with_a_mention(spark, corpora, joined_by_shuffle, tmp_path, name):
    """The registry outweighs the documents in both; four times the documents add little to what one task reads."""
    less, more = (most_read(spark, lambda d=d, k=k: catalogue.queries()[name](spark, d).write.parquet(f"{tmp_path}/{k}")) for k, d in enumerate(corpora))
    assert 0 < more < 2 * less
