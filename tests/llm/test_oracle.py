"""The queries' SQL against the operators, on tables with quotations and contaminated documents."""

import random

import duckdb
import pytest
from test_chat import SCHEMA, result

from lodestone.llm import chat, contamination, oracle


def test_quotation_sql_equals_the_operator(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for conv in range(8):
        said = []
        for turn in range(25):
            lines = [" ".join(rng.choice(["One", "two", "ok", "THREE"]) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 3))]
            if said and rng.random() < 0.7:
                old = rng.choice(said).split("\n")
                lines[0:0] = (["On Friday he wrote:"] if rng.random() < 0.4 else []) + [rng.choice(["> ", ">"]) + x for x in old]
            said.append("\n".join(lines))
            rows.append((conv, turn, rng.choice(["user", "assistant"]), said[-1]))
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{tmp_path}/c/*.parquet'")
    found = con.sql(oracle.CHAT)
    want = sorted((tuple(str(r[k]) for k in ("conv_id", "turn", "role", "text", "n_quotes", "n_linked", "reply_to", "thread")) for r in found.to_df().astype(object).where(lambda d: d.notna(), None).to_dict("records")), key=str)
    got = sorted((tuple(map(str, r)) for r in result(chat.link(df))), key=str)
    assert [tuple(x.removesuffix(".0") for x in r) for r in want] == got


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_containment_sql_equals_the_operator(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as from '{sf_dir}/{name}.parquet'")
    got = contamination.contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    want = con.sql(oracle.CONTAMINATION)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
