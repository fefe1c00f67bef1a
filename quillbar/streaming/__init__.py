"""Row-wise operators on a streaming DataFrame."""
