"""Change streams -> current state -> gold -> agent batch -> console, with typed binary keys."""

import datetime as dt

from pyspark.sql import functions as F

from opsloom import schemas
from opsloom.operators.cdc import build_flows
from opsloom.plans import console, jobs
from opsloom.sources.history import read_history, read_history_stream
from opsloom.sources.tables import Tables
from opsloom.streaming.current_state import read_current_state, run_flows
from tests.helpers import key, rows
from tests.test_agent import AS_OF, desk


def test_from_changes_to_console(spark, tmp_path):
    t, flows = desk(spark), build_flows(list(schemas.CURRENT_STATE_TABLES))
    change = {"_lsn": F.lit(1).cast("long"), "_xid": F.lit(1).cast("long"), "_timestamp": F.lit(dt.datetime(2024, 5, 1))}
    for name in flows:
        rows_in = t[name].withColumns({"_change_type": F.lit("insert"), **change})
        late_delete = rows_in.limit(1).withColumns({"_change_type": F.lit("delete"), "_lsn": F.lit(0).cast("long")})
        both = rows_in.unionByName(late_delete)
        both.select(*schemas.history_schema(schemas.CURRENT_STATE_TABLES[name]).names).write.parquet(f"{tmp_path}/bronze/{name}")

    streams = {
        name: read_history_stream(spark, f"{tmp_path}/bronze/{name}", schemas.history_schema(table))
        for name, table in schemas.CURRENT_STATE_TABLES.items()
    }
    run_flows(streams, flows, f"{tmp_path}/silver")
    silver = Tables(
        spark,
        {
            name: read_current_state(spark, f"{tmp_path}/silver/{name}", flows[name], schemas.history_schema(table))
            for name, table in schemas.CURRENT_STATE_TABLES.items()
        },
    )
    for name, flow in flows.items():
        batch = flow.current(read_history(spark, f"{tmp_path}/bronze/{name}", schemas.CURRENT_STATE_TABLES[name]))
        key_of = lambda r: repr(sorted(r.items()))
        assert sorted(rows(silver[name]), key=key_of) == sorted(rows(batch), key=key_of) == sorted(rows(t[name]), key=key_of)

    gold = jobs.refresh_gold(silver, f"{tmp_path}/gold", AS_OF)
    assert gold["user_support_profile"].count() == 2

    def reply(instructions, pieces):
        prompt = "\n".join(pieces)
        return '{"case_summary":"sum","suggested_action":"credit","suggested_amount_cents":50}' if "Subject" in prompt else "x"

    now = F.lit(dt.datetime(2024, 6, 1, 12)).cast("timestamp")
    drafts = jobs.run_agent(gold, reply, "m", AS_OF, now, str(tmp_path), schemas.AGENT_RESPONSE_SCHEMA)
    assert spark.read.parquet(f"{tmp_path}/agent_quarantine").count() == 0 and not (tmp_path / "reply_ledger").exists()
    copied = jobs.sync_responses(spark, f"{tmp_path}/agent_responses", schemas.AGENT_RESPONSE_SCHEMA, f"{tmp_path}/console")
    assert copied == 1 and spark.read.parquet(f"{tmp_path}/console").count() == drafts.count() > 0
    snapshots = jobs.sync_snapshots({name: gold[name] for name in jobs.SNAPSHOT_KEYS}, f"{tmp_path}/snapshots")
    assert {n: df.count() for n, df in snapshots.items()} == {n: gold[n].count() for n in jobs.SNAPSHOT_KEYS}
    queue = {bytes(r["case_id"]): r for r in rows(console.case_queue(silver.with_tables(drafts=drafts)))}
    assert (queue[key(1)]["suggested_action"], queue[key(1)]["case_summary"]) == ("credit", "sum")
    assert queue[key(3)]["suggested_action"] is None
