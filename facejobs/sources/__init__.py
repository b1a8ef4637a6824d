"""Reading frames and requests, and the stored gallery and guest frames."""

from facejobs.sources.frames import decode_payload, detect_faces, detect_once, explode_frames, read_image_files, validate_requests
from facejobs.sources.stores import Gallery, gallery_version, guest_file_names, purge_versions, put_if_absent, read_gallery, update_gallery, write_gallery, write_guest_frames

__all__ = [
    "Gallery", "decode_payload", "detect_faces", "detect_once", "explode_frames", "gallery_version", "guest_file_names", "purge_versions", "read_gallery",
    "put_if_absent", "read_image_files", "update_gallery", "validate_requests", "write_gallery", "write_guest_frames",
]
