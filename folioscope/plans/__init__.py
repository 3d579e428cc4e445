"""The query registry and the driver-side validation of requests."""
