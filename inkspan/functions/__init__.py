"""Part of inkspan."""
