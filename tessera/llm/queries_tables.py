"""Queries of token counts, sharding, packing and media over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents, stash
from .packing import pack
from .sharding import shard_documents
from .subwords import sample_segmentations
from .telephony import decode_audio, store_audio
from .tokens import length_histogram, suffix_sums


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(stash(length_histogram(documents(spark, sf_dir)), "lengths"))


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op10_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files are written and read back; the resampled PCM is a column of the result."""
    media = stash(store_audio(documents(spark, sf_dir)), "media", codec="zstd")
    return decode_audio(media, keep_pcm=True)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_sentencepiece_sampling, op6_sharding, op8_best_fit_packing, op10_telephony_audio)}
ORACLE: dict[str, str] = {}
