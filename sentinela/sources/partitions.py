"""Landing folders partitioned by ingestion date."""

from __future__ import annotations


def ingestion_path(root: str, dt_ref: str, file_name: str | None = None) -> str:
    """Folder of one ingestion date, or one file in it; ``none`` means the whole folder."""
    path = f"{root.rstrip('/')}/ingestion_date={dt_ref}/"
    if file_name and file_name.lower() != "none":
        path += file_name
    return path
