"""tablewright.sources"""
