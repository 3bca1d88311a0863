"""The workbench's entities as DDL: payloads are parsed once into these columns."""

FILES = "id string, file_name string, file_type string, file_size bigint, extension string, source_kind string, archive_parent_id string, status string, has_formula boolean, has_omml boolean, missing_omml_dependency boolean, has_macro boolean, has_image boolean, validation_errors array<string>, content_summary map<string,string>, created_at timestamp"
TASKS = "id string, task_type string, execute_mode string, file_ids array<string>, options map<string,string>, status string, progress int, error_message string, start_time timestamp, end_time timestamp, created_at timestamp"
FORMULAS = "report_id string, id string, file_id string, page_index int, position string, source_type string, latex string, mathml string, confidence int, status string, format_status string"
MACROS = "report_id string, id string, macro_name string, execute_order int, file_id string, execute_status string, failure_strategy string, confirmed boolean"
OMML = "report_id string, id string, file_id string, omml_file_name string, found_status string, copy_status string"
IMAGES = "report_id string, id string, file_id string, page_index int, location string, width int, height int, image_type string, confidence int, is_small boolean, is_header_footer boolean, is_watermark boolean, is_transparent boolean, is_duplicate boolean, image_hash string, export_status string"
ARTIFACTS = "report_id string, file_id string, name string, path string, status string, size bigint, sha256 string, modified_at timestamp"
BATCH = "report_id string, file_id string, status string, skipped boolean"
IMAGE_ERRORS = "report_id string, file_id string, message string"
REPORT_FILES = "report_id string, file_id string, file_name string, validation_errors array<string>, missing_omml_dependency boolean"
REPORTS = "id string, task_id string, task_type string, created_at timestamp, seq bigint"
LOGS = "id bigint, task_id string, message string, level string, category string, created_at timestamp"
