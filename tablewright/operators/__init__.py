"""tablewright.operators"""
