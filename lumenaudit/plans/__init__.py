"""lumenaudit.plans"""
