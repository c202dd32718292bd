"""Declared schemas of the library's tables."""

BOX = "struct<x1: double, y1: double, x2: double, y2: double>"
CANDIDATE = "struct<face_id: string, person_id: string, photo_id: string, score: double, name: string>"
SHARD = "struct<worker_id: string, shard_index: int, idempotency_key: string, process_id: string, status: string, max_photos: bigint>"

TABLES = {
    "face_identity": "face_identity_id string, identity_lookup_hmac string, display_name string, external_identity_hash string, is_active boolean, created_at timestamp, updated_at timestamp",
    "person": "person_id string, face_identity_id string, first_name string, last_name string, national_id_lookup_hmac string, national_id_masked string, details map<string, string>, is_active boolean, deleted_at timestamp, created_at timestamp, updated_at timestamp",
    "person_photo": "photo_id string, person_id string, object_key string, content_sha256 string, mime_type string, width int, height int, status string, deleted_at timestamp, created_at timestamp, updated_at timestamp",
    "face_sample": f"sample_id string, person_id string, photo_id string, detector_model string, embedding_model string, bbox {BOX}, landmarks array<array<double>>, quality_score double, status string, created_at timestamp, updated_at timestamp",
    "recognition_request": "request_id string, query_object_key string, status string, face_count int, top_k smallint, threshold double, created_at timestamp, completed_at timestamp",
    "recognition_result": f"result_id string, request_id string, face_index int, recognition_status string, bbox {BOX}, best_person_id string, best_photo_id string, best_sample_id string, best_score double, candidates array<{CANDIDATE}>, created_at timestamp",
    "process_record": f"process_id string, process_type string, status string, started_at timestamp, completed_at timestamp, summary struct<dataset_type: string, requested_photos: bigint, target_total_active_photos: bigint, starting_active_photos: bigint, shards: array<{SHARD}>>, error_message string, created_at timestamp, updated_at timestamp",
    "process_event": "event_id string, process_id string, sequence int, event_type string, status_before string, status_after string, message string, details map<string, string>, created_at timestamp",
    "sample_vector": "sample_id string, photo_id string, person_id string, active boolean, model_version string, embedding array<float>",
}
