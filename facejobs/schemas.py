"""Schemas of the tables that jobs exchange."""

FRAMES = "sequence_id string, frame_index int, image binary, height int, width int, decode_ok boolean, ts timestamp"
FRAME_STATUS = "sequence_id string, frame_index int, height int, width int, decode_ok boolean"
DETECTIONS = "sequence_id string, frame_index int, face_index int, bbox array<double>, det_score double, embedding array<float>"
MEMBERS = "person_id string, name string, created_at timestamp, embedding_count int, centroid array<double>"
MEMBER_EMBEDDINGS = "person_id string, embedding_index int, embedding array<float>"
#: Per person and vector length: the vectors added up, and how many they are.
MEMBER_SUMS = "person_id string, size int, total array<double>, n long"
POINT = "struct<cx: double, cy: double, width: double, height: double>"

UNKNOWN, GUEST = "unknown", "Guest"
