"""Values that results depend on and that are therefore stated as they are.

Nothing here is logic: names, bucket edges, patterns, caps and label texts only.
"""

# --- fixed values: source registry -------------------------------------------------------------
SEPARATE_OBJECT = "SEPARATE_OBJECT"
SHARED_DISCRIMINATOR = "SHARED_DISCRIMINATOR"
CONFIRMED = "CONFIRMED"
UNVERIFIED = "UNVERIFIED"
RETIRED = "RETIRED"
IDENTIFIER_PATTERN = r"^[A-Za-z][A-Za-z0-9_$#]{0,127}$"

# --- fixed values: source-row identity ---------------------------------------------------------
SCOPE = (
    "source_system",
    "source_owner",
    "source_object",
    "source_copy_id",
    "source_discriminator_column",
    "source_discriminator_value",
)
# Where an entry of the registry shows the scope columns; source_system is given by the caller.
SCOPE_IN_ENTRY = (
    ("source_owner", "physical.owner"),
    ("source_object", "physical.object_name"),
    ("source_copy_id", "copy_id"),
    ("source_discriminator_column", "physical.discriminator_column"),
    ("source_discriminator_value", "physical.discriminator_value"),
)
IDENTITY = (*SCOPE, "source_row_key")
# The same columns in the order to shuffle and sort by: the selective one first.
IDENTITY_KEY = ("source_row_key", *SCOPE)

# --- fixed values: ageing, (last day of bucket, label) in order of age ---------------------------
NOT_DUE = "not-due"
AGE_EDGES = ((30, "0-30"), (60, "31-60"), (90, "61-90"), (180, "91-180"), (365, "181-365"))
OLDEST = ">365"
AGE_BUCKETS = ("0-30", "31-60", "61-90", "91-180", "181-365", ">365", "not-due")

# --- fixed values: promotion outcomes ------------------------------------------------------------
OUTCOMES = ("inserted", "updated", "unchanged", "tombstoned", "revived")

# --- fixed values: evidence ----------------------------------------------------------------------
MACHINE_VERIFIED = "MACHINE_VERIFIED"
OPERATOR_CONFIRMED = "OPERATOR_CONFIRMED"
REJECTED = "REJECTED"
NOTE_COPY = "copy id not found as a cell value in evidence row"
NOTE_OBJECT = "object name not found as a cell value in evidence row"
NOTE_DISCRIMINATOR = "discriminator value not found as a cell value in evidence row"

# --- fixed values: key ranking -------------------------------------------------------------------
STRONG_CANDIDATE = "STRONG_CANDIDATE"
WEAK_CANDIDATE = "WEAK_CANDIDATE"
NO_KEY = "NO_KEY"

# --- fixed values: finance row patterns, sensitive names, secrets --------------------------------
FINANCE_LIKE = (
    "%FIN%", "%MOP%", "%BILLCOLL%", "%TDS%", "%PTC%", "%BUDGET%",
    "%SER%INV%", "%SER%ORD%", "%SITE_REG%", "%GL_REG%",
)
FINANCE_ROW = "(FIN|MOP|BILLCOLL|TDS|PTC|PETTY|BUDGET|SERINV|SERORD|SITE_REG|GL_REG|OTSD|OUTSTAND)"
SENSITIVE_COLUMN = "(USER|EMAIL|MAIL|PASSW|PWD|CREATED_BY|UPDATED_BY|MODIFIED_BY|AUTHOR)"
SECRET_ASSIGNMENT = r"\b(password|pwd|uid)\s*=\s*[^;\s]+"
MASK = "***"
MIN_SECRET_LENGTH = 3

# --- fixed values: size of the bounded reports -------------------------------
GROUP_CAP = 100
SAMPLE_ROWS = 5

# --- fixed values: money -------------------------------------------------------------------------
MONEY = "decimal(20,2)"
TOTAL = "decimal(24,2)"
