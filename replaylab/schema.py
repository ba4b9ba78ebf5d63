"""Schemas of the raw export and of the normalised ``history`` table.

The raw export is read with an explicit all-string schema: no inference pass
runs, absent keys come back as NULL, and keys that are not listed (network
address, device fingerprint) are never materialised by the JSON reader.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Raw export key -> history column -> SQL type, in the
# order of the history table. These must match the export format.
MAPPING: list[tuple[str, str, str]] = [
    ("ts", "ts", "TIMESTAMP"),
    ("username", "username", "STRING"),
    ("platform", "platform", "STRING"),
    ("ms_played", "ms_played", "BIGINT"),
    ("conn_country", "conn_country", "STRING"),
    ("master_metadata_track_name", "track_name", "STRING"),
    ("master_metadata_album_artist_name", "artist_name", "STRING"),
    ("master_metadata_album_album_name", "album_name", "STRING"),
    ("spotify_track_uri", "track_uri", "STRING"),
    ("episode_name", "episode_name", "STRING"),
    ("episode_show_name", "episode_show_name", "STRING"),
    ("spotify_episode_uri", "episode_uri", "STRING"),
    ("reason_start", "reason_start", "STRING"),
    ("reason_end", "reason_end", "STRING"),
    ("shuffle", "shuffle", "BOOLEAN"),
    ("skipped", "skipped", "BOOLEAN"),
    ("offline", "offline", "BOOLEAN"),
    ("offline_timestamp", "offline_timestamp", "TIMESTAMP"),
    ("incognito_mode", "incognito_mode", "BOOLEAN"),
]

# Export keys that must never be read (privacy).
PRIVATE_KEYS: tuple[str, ...] = ("ip_addr", "ip_addr_decrypted", "user_agent_decrypted")

_SQL_TO_SPARK = {
    "TIMESTAMP": T.TimestampType(),
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "BOOLEAN": T.BooleanType(),
}

# Every mapped raw key read as text; casts happen in ``normalize``.
RAW = T.StructType([T.StructField(src, T.StringType(), True) for src, _, _ in MAPPING])

HISTORY = T.StructType(
    [T.StructField(tgt, _SQL_TO_SPARK[sql], True) for _, tgt, sql in MAPPING]
)

HISTORY_COLUMNS: tuple[str, ...] = tuple(f.name for f in HISTORY.fields)
