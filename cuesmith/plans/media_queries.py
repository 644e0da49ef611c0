"""Sound and picture files, written from the driver's tables and read by the sources."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import pictures, sound
from ..sources.scratch import fresh_folder
from .registry import query, table

RATE = 8


def _put(folder: str, name: str, data: bytes) -> None:
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(data)


def recordings(spark, sf_dir) -> str:
    """A folder of a WAV file for each user: a sample for each event, in turn, 8 to the second."""
    at = fresh_folder(spark)

    def write(group: pd.DataFrame) -> pd.DataFrame:
        samples = (group.sort_values("event_id")["value"] * 60).astype(int).clip(-32768, 32767).to_numpy()
        _put(at, f"{group['user_id'].iloc[0]}.wav", sound.wav_bytes(samples, RATE))
        return group[["user_id"]].head(1)

    table(spark, sf_dir, "events").select("user_id", "event_id", "value").groupBy("user_id").applyInPandas(write, "user_id long").count()
    return at


def _number() -> Column:
    """The number that a file is named by."""
    return F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long")

_SAMPLES = "s AS (SELECT user_id, CAST(least(greatest(trunc(value * 60), -32768), 32767) AS BIGINT) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)"


@query("t11_wav_loudness", f"WITH {_SAMPLES}, w AS (SELECT user_id, k // 2 AS w, sum(x * x) / count(*) AS p FROM s GROUP BY 1, 2) SELECT user_id, w * 2 / 8 AS at, round(CASE WHEN p <= 0 THEN -96.0::DOUBLE ELSE 20 * log10(sqrt(p) / 32768) END, 6) AS db FROM w")
def wav_loudness(spark, sf_dir):
    levels = sound.loudness(spark, recordings(spark, sf_dir), range_bytes=50)
    return levels.select(_number().alias("user_id"), "at", F.round("db", 6).alias("db"))


@query("t11_wav_envelopes", f"WITH {_SAMPLES}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), w AS (SELECT user_id, k // greatest(1, n // 128) AS w, sqrt(sum(x * x) / count(*)) AS rms FROM s JOIN n USING (user_id) GROUP BY 1, 2), p AS (SELECT user_id, max(rms) AS peak FROM w WHERE w < 128 GROUP BY 1), e AS (SELECT user_id, unnest(range(128)) AS w FROM n) SELECT e.user_id, e.w AS bin, CASE WHEN peak > 0 THEN round(coalesce(rms, 0) / peak, 6) ELSE 0 END AS level FROM e JOIN p USING (user_id) LEFT JOIN w ON w.user_id = e.user_id AND w.w = e.w")
def wav_envelopes(spark, sf_dir):
    read = sound.envelopes(spark, recordings(spark, sf_dir), range_bytes=50)
    return read.select(_number().alias("user_id"), F.posexplode("envelope").alias("bin", "level")).select("user_id", F.col("bin").cast("long").alias("bin"), "level")


def bitmap(rows: np.ndarray) -> bytes:
    """A BMP file of 24 bits of grey values, whose width is a multiple of 4."""
    height, width = rows.shape
    data = np.repeat(rows[::-1].astype(np.uint8), 3).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(data), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(data), 2835, 2835, 0, 0) + data


def frames(spark, sf_dir) -> str:
    """A folder of an image for each vector: its 64 entries as 8 x 8 grey squares of 4 x 4 pixels."""
    at = fresh_folder(spark)

    def write(batches):
        for batch in batches:
            for name, v in zip(batch["vec_id"], batch["v"], strict=True):
                _put(at, f"{name}.bmp", bitmap(np.kron(np.array(v).reshape(8, 8), np.ones((4, 4)))))
            yield batch[["vec_id"]]

    values = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 400) + 128)).cast("int"))
    table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", values.alias("v")).mapInPandas(write, "vec_id long").count()
    return at


_PIXELS = "v AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, CAST(floor(CAST(x AS DOUBLE) * 400) AS BIGINT) + 128))) AS v FROM embeddings WHERE len(embedding) = 64)"


@query("x10_image_hashes", f"WITH {_PIXELS} SELECT vec_id, array_to_string(list_transform(range(256), lambda k: CASE WHEN v[(k // 32) * 8 + (k % 16) // 2 + 1] >= list_sum(v) / 64 THEN '1' ELSE '0' END), '') AS bits FROM v")
def image_hashes(spark, sf_dir):
    read = pictures.image_hashes(spark, frames(spark, sf_dir))
    bits = F.array_join(F.transform("words", lambda w: F.lpad(F.bin(w), 64, "0")), "")
    return read.select(_number().alias("vec_id"), bits.alias("bits"))
