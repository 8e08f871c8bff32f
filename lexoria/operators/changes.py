"""Apply a feed of inserts, updates and deletes to a keyed table.

Each bucket of keys has its own embedded DuckDB, which upserts the bucket's changes batch by batch:
a conflict updates the stored row only if the incoming change is the one in force (later clock, of
equal clocks the lower sequence). Tombstones stay in the state, so a change that arrives after a
delete, but was made before it, is still refused. The same upsert runs before the shuffle over each
input partition, so that a key with a large share of all changes crosses the network a few times
only. Bucket results are exported as Arrow, written to a staging table and published by one rename.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexoria.plans.runtime import publish, shuffle_width

#: Upper limits for one bucket's input, which its state can't exceed; more make more buckets.
ROWS_PER_BUCKET, BYTES_PER_BUCKET = 2_000_000, 128 << 20
#: Memory of one bucket's database, which never spills to a machine's disk.
MEMORY_MB = 512
#: Bytes of state that an input partition holds before it hands its rows on.
LOCAL_BYTES = 128 << 20


def _upserter(cols: list[str], keys: list[str], order: list[tuple[str, str]], most: float = float("inf")):
    """The function of one bucket. `order`: (column, 'asc' or 'desc'), the first row is in force. After
    `most` bytes of input the state is handed on and begun anew."""
    q = lambda c: '"' + c.replace('"', '""') + '"'
    names = [q(c) for c in cols]
    tests, equal = [], []
    for c, way in order:
        tests.append(" and ".join([*equal, f"excluded.{q(c)} {'>' if way == 'desc' else '<'} state.{q(c)}"]))
        equal.append(f"excluded.{q(c)} = state.{q(c)}")
    values = [c for c in cols if c not in keys]
    upsert = (
        f"insert into state select {', '.join(names)} from (select *, row_number() over (partition by "
        f"{', '.join(map(q, keys))} order by {', '.join(f'{q(c)} {way}' for c, way in order)}) as _lex_nth from feed) "
        f"where _lex_nth = 1 on conflict ({', '.join(map(q, keys))}) do update set "
        f"{', '.join(f'{q(c)} = excluded.{q(c)}' for c in values)} where {' or '.join(f'({t})' for t in tests)}"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db, schema, held = None, None, 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for out in db.sql(f"select {', '.join(names)} from state").to_arrow_reader(20_000):
                yield out.cast(schema) if out.schema != schema else out

        for batch in batches:
            if not batch.num_rows:
                continue
            if held > most:  # before the shuffle: the rest starts anew, so a key may be handed on twice
                yield from hand_on()
                db.close()
                db, held = None, 0
            held += batch.nbytes
            if db is None:
                schema = batch.schema
                db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": "", "preserve_insertion_order": False})
                db.register("feed", pa.Table.from_batches([batch]))
                db.execute(f"create table state as select {', '.join(names)} from feed limit 0")
                db.execute(f"create unique index state_key on state ({', '.join(map(q, keys))})")
            else:
                db.register("feed", pa.Table.from_batches([batch]))
            db.execute(upsert)
            db.unregister("feed")
        if db is not None:
            yield from hand_on()
            db.close()

    return run


def _buckets(rows: DataFrame) -> int:
    """As many buckets as keep each one's input within both limits."""
    wide = [c for c, t in rows.dtypes if not t.startswith(("int", "bigint", "timestamp", "double", "date", "float", "smallint", "tinyint", "boolean"))]
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in wide), F.lit(8 * len(rows.columns)))
    got = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return max(shuffle_width(rows.sparkSession), -(-got["n"] // ROWS_PER_BUCKET), -(-got["b"] // BYTES_PER_BUCKET))


def apply_changes(
    feed: DataFrame,
    keys: Sequence[str] = ("user_id", "word"),
    clock: str = "updated_at",
    seq: str = "seq",
    deleted: str = "deleted",
    payload: Sequence[str] = (),
    base: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """The state of the keyed table after all changes, tombstones included, as a published table.

    In force for a key is the change with the latest `clock`; of equal ones that with the lowest
    `seq`; of still equal ones a tombstone, then the change with more payload filled in, then a fixed
    order by hash, so repeated and out-of-order deliveries give one result. Columns: keys, `clock`,
    `seq`, `deleted`, payload. Changes with a null key or clock count for nothing; a null `seq` comes
    after all others; a null `deleted` is kept and is neither live nor a tombstone. An empty feed
    gives an empty state. Columns of the feed that aren't named are ignored, whatever they are
    called. `base`, an earlier state with the same columns, takes part as if it were changes.
    """
    keys, payload = list(keys), list(payload)
    kept = [*keys, clock, seq, deleted, *payload]
    rows = feed.select(*kept)
    if base is not None:
        rows = rows.unionByName(base.select(*kept))
    for c in [*keys, clock]:
        rows = rows.where(F.col(f"`{c}`").isNotNull())
    filled = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in payload), F.lit(0))
    rows = rows.withColumns(
        {
            "_lex_seq": F.coalesce(F.col(f"`{seq}`").cast("long"), F.lit((1 << 63) - 1)),
            "_lex_dead": F.coalesce(F.col(f"`{deleted}`").cast("int"), F.lit(0)),
            "_lex_full": filled.cast("int"),
            "_lex_tie": F.xxhash64(*[F.col(f"`{c}`") for c in [deleted, *payload]]),
        }
    )
    order = [(clock, "desc"), ("_lex_seq", "asc"), ("_lex_dead", "desc"), ("_lex_full", "desc"), ("_lex_tie", "asc")]
    step = _upserter(rows.columns, keys, order)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
    n = buckets or _buckets(rows)
    local = rows.mapInArrow(_upserter(rows.columns, keys, order, LOCAL_BYTES), schema)
    state = local.repartition(n, *[F.col(f"`{c}`") for c in keys]).mapInArrow(step, schema)
    return publish(state.select(*[F.col(f"`{c}`") for c in kept]), "state")


def live(state: DataFrame, deleted: str = "deleted") -> DataFrame:
    """The rows of a state that aren't deleted."""
    return state.where(F.col(deleted) == 0)
