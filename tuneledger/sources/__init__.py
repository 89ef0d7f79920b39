"""Inputs: messy sheets, the stored warehouse and the test data mapped to the star schema."""
