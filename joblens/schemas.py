"""Table schemas (as DDL text) and the fixed values the operators share."""

# Job states, in life-cycle order.
CREATED = "CREATED"
CONVERTING = "CONVERTING"
FAILED = "FAILED"
SUCCESSFUL = "SUCCESSFUL"
STATUSES = [CREATED, CONVERTING, FAILED, SUCCESSFUL]

# Kinds of a job change that are not states.
SUBMIT = "SUBMIT"
DELETE = "DELETE"

# Event names.
STATUS_EVENT = "status"
LINE_EVENT = "outputLine"
RETURN_EVENT = "carriageReturn"

SUBMISSIONS = "submission_id string, video string, ts timestamp"

JOBS = (
    "id string, video string, store_name string, status string, failure_reason string, "
    "process string, raw_output string, file_name string, updated_at timestamp, version bigint"
)

JOB_EVENTS = "job_id string, seq bigint, name string, data string, ts timestamp"

JOB_CHANGES = "job_id string, store_name string, kind string, ts timestamp, version bigint"

COMPLETED = "store_name string, file_name string"

RESULT_FILES = "store_name string, modification_time timestamp, end_ms bigint, length bigint"

# One persisted job record. The left names are the stored JSON fields, the right ones our columns.
RECORD_FIELDS = {
    "id": "id",
    "video": "video",
    "status": "status",
    "failureReason": "failure_reason",
    "process": "process",
    "rawOutput": "raw_output",
    "fileName": "file_name",
    "storeName": "store_name",
}
RECORD_EVENTS = "array<struct<name:string,id:string,data:string>>"
