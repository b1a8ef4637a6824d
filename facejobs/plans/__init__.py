"""Whole jobs, composed of operators."""

from facejobs.plans.jobs import BatchResults, enroll_batch, enroll_images, identify_batch

__all__ = ["BatchResults", "enroll_batch", "enroll_images", "identify_batch"]
