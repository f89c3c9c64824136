"""DataFrame operators over tables, requests and logs."""
