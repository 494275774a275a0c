"""Column contracts of catalog tables: required columns must be there, optional ones read as null when absent."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CorruptData(ValueError):
    """Data that the format does not allow."""


def conform(df: DataFrame, required: Mapping[str, str], optional: Mapping[str, str] | None = None) -> DataFrame:
    """Exactly the declared columns, cast to the declared types.

    A missing required column raises; a missing optional column is null in every row.  Names match exactly.
    """
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise CorruptData(f"missing columns: {', '.join(absent)}")
    kept = [F.col(f"`{c}`").cast(t).alias(c) for c, t in required.items()]
    extra = [(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in (optional or {}).items()]
    return df.select(*kept, *extra)


#: Catalog tables by name: required columns, then optional ones.
TABLES: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "connection_config": ({"connection_config_id": "bigint", "connection_id": "string"}, {"version_type": "int"}),
    "workload_config": ({"workload_id": "bigint", "workload_uid": "string", "workload_type": "string", "workload_spec": "string"}, {}),
    "copy_target_version": (
        {"version_id": "bigint", "workload_id": "bigint", "connection_config_id": "bigint", "version_uid": "string", "target_type": "string", "target_id": "string", "deleted": "int", "version_spec": "string"},
        {"saas_stream_uuid": "string", "saas_snapshot_uuid": "string", "saas_version_id": "bigint"},
    ),
    "copy_target_version_meta": ({"version_uid": "string", "target_meta_path": "string"}, {"meta_filenames": "string", "status": "int"}),
    "copy_target_file": ({"version_id": "bigint", "fid": "bigint"}, {}),
    "file_meta": ({"fid": "bigint", "path": "string", "file_size": "bigint"}, {}),
    "file_map": ({"path": "string", "stream_id": "int", "session_id": "bigint", "comp_offset": "bigint", "status": "int"}, {"block": "bigint", "crtime": "string", "mtime": "string"}),
    "vault_link_key": ({"key": "string"}, {}),
    "vault_encryption_key": ({"user_key_uuid": "string", "encrypted_data_key": "string"}, {"crtime": "string"}),
    "snapshot_info": ({"snapshot_id": "bigint", "snapshot_uuid": "string"}, {"first_version_id": "bigint", "stream_version": "bigint"}),
    "version_info": ({"snapshot_id": "bigint", "version_id": "bigint", "stream_version": "bigint"}, {"deleted": "int"}),
}


def catalog_table(df: DataFrame, name: str) -> DataFrame:
    """A catalog table in its declared shape."""
    return conform(df, *TABLES[name])
