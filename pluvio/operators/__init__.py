"""DataFrame to DataFrame operators over pixels, cells, tracks and predictions."""
