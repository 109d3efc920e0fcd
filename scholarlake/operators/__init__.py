"""Analytics, network, resolution, serving and refresh operators, as DataFrame to DataFrame functions."""
