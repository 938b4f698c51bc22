"""Fixed schemas of the control tables and the mart."""

from pyspark.sql import types as T

_text = T.StringType()
_date = T.DateType()
_flag = T.BooleanType()
_time = T.TimestampType()
_money = T.DecimalType(20, 2)
_total = T.DecimalType(24, 2)


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


PHYSICAL = _struct(
    ("owner", _text, True),
    ("object_name", _text, True),
    ("object_type", _text, True),
    ("access_mode", _text, True),
    ("discriminator_column", _text, True),
    ("discriminator_value", _text, True),
)

REGISTRY = _struct(
    ("source_type", _text, False),
    ("logical_cube_name", _text, False),
    ("copy_id", _text, False),
    ("financial_year", _text, True),
    ("date_from", _date, False),
    ("date_to", _date, False),
    ("is_current", _flag, False),
    ("is_auto_refresh", _flag, False),
    ("last_refresh_at", _text, True),
    ("status", _text, False),
    ("authoritative", _flag, False),
    ("physical", PHYSICAL, True),
    ("physical_hint", _text, True),
)

ADDITIONS_JSON = _struct(
    ("source_type", _text, True),
    ("logical_cube_name", _text, True),
    ("copy_id", _text, True),
    ("financial_year", _text, True),
    ("date_from", _text, True),
    ("date_to", _text, True),
    ("is_current", _flag, True),
    ("is_auto_refresh", _flag, True),
)

# The evidence of an overlay record may be a sentence or an object; it is kept as its JSON text.
OVERLAY_VALUE = _struct(
    ("status", _text, True),
    ("physical", PHYSICAL, True),
    ("last_refresh_at", _text, True),
    ("evidence", _text, True),
)

IDENTITY = tuple(
    (name, _text, False)
    for name in (
        "source_system", "source_owner", "source_object", "source_copy_id",
        "source_discriminator_column", "source_discriminator_value", "source_row_key",
    )
)

LEDGER_PAYLOAD = (
    ("site_code", _text, True),
    ("entry_glcode", _text, True),
    ("entry_slcode", _text, True),
    ("entry_no", _text, True),
    ("entry_date", _date, False),
    ("entry_type", _text, True),
    ("narration", _text, True),
    ("debit", _money, False),
    ("credit", _money, False),
    ("release_status", _text, True),
)

STAGING = _struct(
    *IDENTITY,
    ("source_financial_year", _text, True),
    ("extract_batch_id", _text, False),
    ("extracted_at", _time, False),
    ("row_hash", _text, False),
    ("payload", _text, False),
)

FACT = _struct(
    *LEDGER_PAYLOAD,
    *IDENTITY,
    ("source_financial_year", _text, True),
    ("row_hash", _text, False),
    ("canonical_txn_key", _text, True),
    ("extract_batch_id", _text, False),
    ("extracted_at", _time, False),
    ("source_deleted_at", _time, True),
)

RECON_RUN = _struct(
    ("run_at", _time, False),
    ("scope", _text, False),
    ("check_name", _text, False),
    ("source_value", _total, False),
    ("mart_value", _total, False),
    ("kpi_value", _total, True),
    ("explanation", _text, True),
    ("passed", _flag, False),
)
