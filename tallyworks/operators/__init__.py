"""DataFrame operators over usage events and what is derived from them."""
