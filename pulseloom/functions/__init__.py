"""Column helpers and small numeric kernels that run inside tasks."""
