"""tablewright.plans"""
