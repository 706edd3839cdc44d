"""Folders for queries whose feature is writing."""

import uuid

from pyspark.sql import SparkSession

from lanewise.session import shared_folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder of the cluster."""
    return f"{shared_folder(spark)}/lanewise-{name}-{uuid.uuid4().hex}"
