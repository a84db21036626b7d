"""Problem 6: a sample that stays as data grows, by randomised block selection.

An id is a persistent sequence number: its block is id div block_size. In every block, filled or not, a keyed
permutation of the positions, a Feistel network over a hash of the block number, puts exactly `chosen` positions first.
Whether an id is a member depends on nothing but the id, so members stay whatever is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_BITS = 5
BLOCK_SIZE = 1 << (2 * HALF_BITS)
CHOSEN = 102
ROUNDS = 4
SEED = 17


def position_rank(id_col: Column, seed: int = SEED, half_bits: int = HALF_BITS, rounds: int = ROUNDS) -> Column:
    """Rank of an id's position in its block, a permutation of 0 .. block_size - 1 for each block."""
    size = 1 << half_bits
    block = F.shiftright(id_col, 2 * half_bits)
    position = id_col.bitwiseAND(F.lit(size * size - 1).cast("bigint"))
    left, right = F.shiftright(position, half_bits), position.bitwiseAND(F.lit(size - 1).cast("bigint"))
    for r in range(rounds):
        text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(r)), block.cast("string"), right.cast("string"))
        value = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % size
        left, right = right, left.bitwiseXOR(value)
    return left * size + right


def block_sample(df: DataFrame, id_col: str = "doc_id", chosen: int = CHOSEN, seed: int = SEED) -> DataFrame:
    """Rows of `df` whose id holds one of the `chosen` positions of its block of 1,024 ids; all columns stay.

    Rows with a null id are never chosen; repeated ids are all chosen or none; negative ids have blocks of their own.
    """
    if df.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{id_col} must be an integer sequence number")
    return df.filter(F.col(id_col).isNotNull()).filter(position_rank(F.col(id_col).cast("bigint"), seed) < chosen)


def sample_sql(view: str = "documents", id_col: str = "doc_id", chosen: int = CHOSEN, seed: int = SEED) -> str:
    """The same sample of ids in DuckDB's SQL."""
    size = 1 << HALF_BITS
    ctes = [f"r0 AS (SELECT {id_col}, {id_col} >> {2 * HALF_BITS} AS b, ({id_col} & {size * size - 1}) >> {HALF_BITS} AS l, {id_col} & {size - 1} AS r FROM {view} WHERE {id_col} IS NOT NULL)"]
    for i in range(ROUNDS):
        value = f"(('0x' || substr(md5('{seed}:{i}:' || b || ':' || r), 1, 8))::BIGINT % {size})"
        ctes.append(f"r{i + 1} AS (SELECT {id_col}, b, r AS l, xor(l, {value}) AS r FROM r{i})")
    return f"WITH {', '.join(ctes)} SELECT {id_col} FROM r{ROUNDS} WHERE l * {size} + r < {chosen}"
