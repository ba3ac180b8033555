"""Configurations, run folders and JSON reports, through Spark's file systems: paths may lie in any store that Spark reads."""

from __future__ import annotations

import json
import platform
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession


class ConfigError(ValueError):
    """A configuration can't be read, or lacks a section."""


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as UTF-8."""
    if not exists(spark, path):
        raise ConfigError(f"{path} is not there")
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()


def write_report(spark: SparkSession, report: dict | DataFrame, path: str) -> None:
    """A report as indented JSON with sorted keys; of a DataFrame, its one row."""
    if isinstance(report, DataFrame):
        rows = report.limit(2).toJSON().collect()
        if len(rows) != 1:
            raise ValueError("a report has one row")
        report = json.loads(rows[0])
    files, place = _place(spark, path)
    out = files.create(place, True)
    try:
        out.write(bytearray((json.dumps(report, indent=2, ensure_ascii=False, sort_keys=True) + "\n").encode()))
    finally:
        out.close()


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def load_config(spark: SparkSession, path: str) -> dict:
    """A YAML mapping."""
    import yaml

    try:
        found = yaml.safe_load(read_text(spark, path))
    except (yaml.YAMLError, UnicodeDecodeError) as error:
        raise ConfigError(f"{path} is no YAML: {error}") from error
    if not isinstance(found, dict):
        raise ConfigError(f"{path} holds no mapping")
    return found


def require_sections(config: dict, *names: str) -> None:
    """Raises for sections that are missing or no mappings."""
    wrong = [n for n in names if not isinstance(config.get(n), dict)]
    if wrong:
        raise ConfigError(f"sections are missing: {', '.join(wrong)}")


def environment(spark: SparkSession) -> dict:
    """What a run ran on."""
    return {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "master": spark.sparkContext.master, "time_zone": spark.conf.get("spark.sql.session.timeZone")}


def start_run(spark: SparkSession, folder: str, name: str, config: dict, now: datetime | None = None) -> str:
    """A new run's folder, named by time, with its configuration and environment; raises if it is there already."""
    path = f"{folder.rstrip('/')}/{(now or datetime.now(UTC)).strftime('%Y%m%dT%H%M%SZ')}_{name}"
    if exists(spark, path):
        raise FileExistsError(path)
    write_report(spark, config, f"{path}/config.json")
    write_report(spark, environment(spark), f"{path}/environment.json")
    return path


def resume_run(spark: SparkSession, path: str, config: dict) -> str:
    """A run's folder, whose saved configuration must be this one."""
    if read_report(spark, f"{path}/config.json") != json.loads(json.dumps(config)):
        raise ConfigError(f"{path} was started with another configuration")
    return path
