"""Results depend on these exact lists, numbers and patterns."""

# File extensions and folders of a code tree.
CODE_EXTENSIONS = (".py", ".sql", ".yml", ".yaml", ".md", ".txt")
SKIPPED_FOLDERS = (
    ".git", "__pycache__", "node_modules", ".venv", "venv", ".mypy_cache",
    ".tox", "dist", "build", ".eggs", ".pytest_cache",
)

# Words that cannot be table names, nor unquoted column names.
SQL_KEYWORDS = (
    "SELECT", "FROM", "WHERE", "JOIN", "LEFT", "RIGHT", "INNER", "OUTER", "ON", "AND", "OR", "NOT",
    "IN", "IS", "NULL", "TRUE", "FALSE", "INSERT", "INTO", "VALUES", "UPDATE", "SET", "DELETE",
    "CREATE", "TABLE", "VIEW", "INDEX", "IF", "EXISTS", "AS", "WITH", "HAVING", "GROUP", "ORDER",
    "BY", "ASC", "DESC", "LIMIT", "OFFSET", "UNION", "ALL", "DISTINCT", "CASE", "WHEN", "THEN",
    "ELSE", "END", "CAST", "OVER", "PARTITION", "ROWS", "BETWEEN", "LIKE", "ILIKE", "USING", "FULL",
    "CROSS", "NATURAL", "RETURNING", "TEMPORARY", "TEMP", "REPLACE", "TRUNCATE", "DROP", "ALTER",
    "ADD", "COLUMN", "TYPE", "VARCHAR", "INTEGER", "INT", "BIGINT", "FLOAT", "DOUBLE", "BOOLEAN",
    "TEXT", "DATE", "TIMESTAMP", "NUMERIC", "DECIMAL", "SERIAL", "CHAR", "STRING", "ARRAY",
    "STRUCT", "MAP", "SMALLINT", "TINYINT", "LONG", "SCHEMA", "DATABASE", "CONSTRAINT", "PRIMARY",
    "FOREIGN", "IDENTITY", "KEY", "UNIQUE", "DEFAULT", "CHECK", "REFERENCES", "INTERVAL", "EPOCH",
    "SECOND", "MINUTE", "HOUR", "DAY", "MONTH", "YEAR", "SORTKEY", "DISTKEY", "ENCODE", "DISTSTYLE",
    "COMPOUND", "INTERLEAVED", "NEXTVAL", "CURRVAL", "NOW", "CURRENT", "START_TIME", "END_TIME",
    "CREATED_AT", "UPDATED_AT", "EVENT", "EVENTS", "LOG", "TYPING", "OS", "SYS", "RE", "JSON",
    "MATH", "TIME", "DATETIME", "RANDOM",
)

# Parts of column names that mark personal data.
PII_WORDS = (
    "email", "phone", "mobile", "cell", "telephone", "ssn", "social_security", "credit_card",
    "card_number", "cvv", "password", "passwd", "pwd", "secret", "dob", "birth", "birthday",
    "birthdate", "address", "street", "zipcode", "postcode", "national_id", "passport", "license",
    "ip_addr", "ip_address", "first_name", "last_name", "fullname", "fname", "lname", "gender",
    "sex", "salary", "income", "bank_account", "latitude", "longitude", "location",
)

# Items of a CREATE TABLE body that start like this are no columns.
NON_COLUMN_PREFIXES = (
    "PRIMARY", "FOREIGN", "UNIQUE", "INDEX", "KEY", "CONSTRAINT", "CHECK", "--", "/*",
)

# Endings of variable names that hold a load statement.
LOAD_SUFFIXES = (
    "_table_insert_delete", "_table_upsert_delete", "_table_insert", "_table_upsert",
    "_table_load", "_insert_delete", "_insert", "_upsert", "_load", "_table",
)

# Class-name parts that mark a call as a workflow task.
TASK_CLASSES = (
    "PythonOperator", "BashOperator", "BranchPythonOperator", "ShortCircuitOperator",
    "DummyOperator", "EmptyOperator", "EmailOperator", "HttpSensor", "SqlSensor",
    "ExternalTaskSensor", "S3KeySensor", "BigQueryOperator", "SparkSubmitOperator",
    "DockerOperator", "KubernetesPodOperator", "SimpleHttpOperator", "TriggerDagRunOperator",
    "SubDagOperator", "LatestOnlyOperator", "PostgresOperator", "MySqlOperator", "MsSqlOperator",
    "SnowflakeOperator", "RedshiftToS3Transfer", "S3ToRedshiftOperator",
    "DataprocSubmitJobOperator", "GCSToGCSOperator", "PythonVirtualenvOperator",
    "ExternalPythonOperator",
)

# Number and date forms a cell may take. An underscore must stand between
# digits. No pattern backtracks over a run of digits, so very long cells stay cheap.
INT_PATTERN = r"^[+-]?\d[\d_]*+$"
FLOAT_PATTERN = (
    r"^[+-]?(?:(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d[\d_]*+)?"
    r"|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
)
LOOSE_UNDERSCORE = r"(?:^|\D)_|_(?:\D|$)"
DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy-M-d'T'H:m:s")

# Thresholds.
CHUNK_SIZE = 400
TOP_K = 5
CONTEXT_HITS = 3
HISTORY_TURNS = 4
SLO_TOLERANCE = 1.1
