"""Search, ranking and graph analytics over short-text social data, on the DataFrame API."""
